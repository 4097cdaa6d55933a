"""Row generators: declarations out of texts, by native expressions for lines and by a parser for markup; files with verified content."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import LINE_BREAK, digest, lines

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def line_declarations(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, name, length): each line that is not blank, named by its first word; lines from 1."""
    each = df.select(key, F.posexplode(lines(F.col(text))).alias("line", "body"))
    return each.select(key, (F.col("line") + 1).cast("long").alias("line"), F.regexp_extract("body", r"\S+", 0).alias("name"), F.length("body").cast("long").alias("length")).where("name <> ''")


class _Spans(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for i, c in enumerate(text):
            if c == "\n":
                self.starts.append(i + 1)
        self.open: list[tuple[str, int]] = []
        self.found: list[tuple[str, int, int, int]] = []
        self.feed(text)
        self.close()

    def _here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.found.append((tag, self._here(), self._here() + len(self.get_starttag_text() or ""), len(self.open)))
        else:
            self.open.append((tag, self._here()))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                end = self._here() + len(tag) + 3
                self.found.append((tag, self.open[i][1], end, i))
                del self.open[i:]
                return


def markup_declarations(df: DataFrame, key: str, text: str = "html") -> DataFrame:
    """(key, name, start, end, depth): the elements of a marked-up text; elements that are never closed give no row, nor does a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _Spans(t).found if t else []
                if found:
                    columns = list(zip(*found))
                    arrays = [pa.array([k] * len(found), batch.schema.field(0).type), pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])]
                    yield pa.RecordBatch.from_arrays(arrays, [key, "name", "start", "end", "depth"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, name string, start long, end long, depth long")


def read_files(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = (".git", "bin", "obj")) -> DataFrame:
    """(path, content, digest, bytes, encoding, newline, text) of the files below a folder; text is null where the bytes are not UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    kept = raw.where(~F.exists(parts, lambda p: p.isin(*skip)))
    bom = F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF"))
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    newline = F.when(text.contains("\r\n"), "crlf").when(text.contains("\n"), "lf").when(text.contains("\r"), "cr").otherwise("none")
    return kept.select("path", "content", digest(F.col("content")).alias("digest"), F.col("length").alias("bytes"), F.when(text.isNull(), "binary").when(bom, "utf-8-bom").otherwise("utf-8").alias("encoding"), newline.alias("newline"), text.alias("text"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status, text): verified where the file is as its manifest has it, else stale or missing."""
    now = files.select("path", F.col("digest").alias("now"), "text")
    both = manifest.select("path", "digest").join(now, "path", "left")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("digest"), "verified").otherwise("stale")
    return both.select("path", status.alias("status"), F.when(status == "verified", F.col("text")).alias("text"))


__all__ = ["LINE_BREAK", "line_declarations", "markup_declarations", "read_files", "verified"]
