"""Scalar text functions: digests, UTF-16 positions, logical lines, canonical ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line ends at CRLF, LF or a lone CR.
LINE_BREAK = r"\r\n|\r|\n"


def digest(x: Column) -> Column:
    """`sha256:` and the lower-case hex of the bytes, or of a string's UTF-8."""
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("long")


def utf16_slice(x: Column, start: Column | int, length: Column | int) -> Column:
    """A span in UTF-16 code units, from 0."""
    at, n = (v if isinstance(v, Column) else F.lit(v) for v in (start, length))
    return F.decode(F.substring(F.encode(x, "UTF-16LE"), at * 2 + 1, n * 2), "UTF-16LE")


def ordinal(x: Column) -> Column:
    """A sort key that orders by UTF-16 code units rather than UTF-8 bytes."""
    return F.encode(x, "UTF-16BE")


def lines(x: Column) -> Column:
    """Logical lines: none for the empty text, one more than its breaks for any other."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, LINE_BREAK, -1))


def line_count(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.regexp_count(x, F.lit(LINE_BREAK)) + 1).cast("long")


def line_of(x: Column, offset: Column) -> Column:
    """The 1-based line of a code point offset; between CR and LF it is still the line that they end."""
    before = F.substring(x, F.lit(1), offset)
    split = F.when(F.endswith(before, F.lit("\r")) & (F.substring(x, offset + 1, F.lit(1)) == "\n"), 1).otherwise(0)
    return F.regexp_count(before, F.lit(LINE_BREAK)) + 1 - split


def newline_class(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("\r\n")), "crlf").when(F.contains(x, F.lit("\n")), "lf").when(F.contains(x, F.lit("\r")), "cr").otherwise("none")


def strip_space(x: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s", "")


def entity_id(prefix: str, *parts: Column) -> Column:
    """prefix_sha256 of the parts, each with its byte length before it, so that no two tuples share a text; null is `-`."""
    one = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws(",", *one), 256))


def entity_pattern(prefix: str) -> str:
    return f"^{prefix}_[0-9a-f]{{64}}$"


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("="))


def normal_path(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def safe_path(x: Column) -> Column:
    """A relative path without empty, `.` or `..` parts, drive or root."""
    parts = F.split(normal_path(x), "/", -1)
    return (x != "") & ~x.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def slug(x: Column) -> Column:
    return F.lower(F.replace(x, F.lit("_"), F.lit("-")))


def shape(text: Column, name: Column) -> Column:
    """The text with the entity's own name replaced, so that a rename leaves it as it was."""
    return F.replace(text, name, F.lit("<name>"))


def part_range(x: Column, part: str) -> Column:
    """(start, length) of a declaration's part, in code points from 0.

    header: up to the first `{`, else the first `=>`, else all, without white space at the end. body: what lies between the first `{` and the last `}`
    (or the end, if none follows); else what follows the first `=>`, without a last `;`; else all. declaration: all.
    """
    size, brace, arrow = F.length(x), F.instr(x, "{") - 1, F.instr(x, "=>") - 1
    if part == "declaration":
        start, length = F.lit(0), size
    elif part == "header":
        cut = F.when(brace >= 0, brace).when(arrow >= 0, arrow).otherwise(size)
        start, length = F.lit(0), F.length(F.regexp_replace(F.substring(x, F.lit(1), cut), r"(?U)\s+\z", ""))
    elif part == "body":
        last = size - F.instr(F.reverse(x), "}")
        close = F.when(F.contains(x, F.lit("}")) & (last > brace), last).otherwise(size)
        semicolon = F.when(F.endswith(x, F.lit(";")) & (size > arrow + 2), 1).otherwise(0)
        start = F.when(brace >= 0, brace + 1).when(arrow >= 0, arrow + 2).otherwise(0)
        length = F.when(brace >= 0, close - brace - 1).when(arrow >= 0, size - arrow - 2 - semicolon).otherwise(size)
    else:
        raise ValueError(f"no part {part}")
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))


def _cut(x: Column, part: str) -> Column:
    at = part_range(x, part)
    return F.substring(x, at["start"] + 1, at["length"])


def header(x: Column) -> Column:
    return _cut(x, "header")


def body(x: Column) -> Column:
    return _cut(x, "body")


def line_starts(x: Column) -> Column:
    """Where each logical line begins, in code points from 0; the empty text has one line."""
    # the last line matches too, so that it isn't tried from each of its characters, and goes again
    parts = F.regexp_extract_all(x, F.lit(r"[^\r\n]*+(?:\r\n|\r|\n|\z)"), F.lit(0))
    parts = F.filter(parts, lambda p: F.endswith(p, F.lit("\n")) | F.endswith(p, F.lit("\r")))
    return F.element_at(F.transform(F.array(F.transform(parts, lambda p: F.length(p))), lambda found: _sums_before(found)), 1)


def _sums_before(lengths: Column, step: int = 256) -> Column:
    """0, and the sums up to and with each element; by runs, so that long arrays don't cost the square of their length."""

    def sums(run: Column, start: Column) -> Column:
        return F.aggregate(run, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / step).cast("int")), lambda b: F.slice(lengths, b * step + 1, step))
    starts = sums(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, n: s + n)), F.lit(0))
    # zipped rather than looked up, so that nothing is worked out anew for each run
    each = F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), sums)
    # a run gives one more than it has: its own start, which is the end of the run before
    return F.flatten(F.transform(each, lambda r, i: F.when(i == 0, r).otherwise(F.slice(r, 2, step))))


def strip_break(x: Column) -> Column:
    """A line without the break that ends it."""
    return F.regexp_replace(x, r"(?:\r\n|\r|\n)\z", "")


def context(x: Column, start_line: Column, end_line: Column, around: int) -> Column:
    """The lines from `around` before the first to `around` after the last, breaks included; lines count from 1."""
    parts = F.regexp_extract_all(x, F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z"), F.lit(0))
    first = F.greatest(F.lit(1), start_line - around)
    return F.array_join(F.slice(parts, first, F.greatest(F.lit(0), end_line + around - first + 1)), "")


def span_valid(x: Column, start: Column, length: Column, start_line: Column, end_line: Column) -> Column:
    """Whether a span lies in the text and both of its line numbers are those of the text."""
    inside = (start >= 0) & (length >= 0) & (start <= F.length(x) - length)
    return F.when(inside, (line_of(x, start) == start_line) & (line_of(x, start + length) == end_line)).otherwise(False)


def generated(path: Column) -> Column:
    """Whether a path is that of generated source."""
    # fixed values: endings and folder names of generated files
    return path.rlike(r"(?i)(\.g\.cs$|\.designer\.cs$|\.generated\.cs$|/generated/|^generated/)")


def keyed(kind: str, **parts: Column) -> Column:
    """sha256 of a canonical JSON of named parts, names in order: texts trimmed, arrays sorted and distinct, nulls written."""
    return digest(F.to_json(F.struct(F.lit(kind).alias("kind"), *(parts[n].alias(n) for n in sorted(parts))), {"ignoreNullFields": "false"}))


def canonical(items: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(items, lambda x: F.trim(x))))


def selection_key(*parts: Column) -> Column:
    """The digest of parts on a line each, null as an empty one."""
    return digest(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "\n"))


def utc(x: Column) -> Column:
    """An ISO 8601 time with its offset as a timestamp; null for any other text."""
    return F.when(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(x))


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero; NaN and infinities are null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, places))


def ratio(num: Column, den: Column) -> Column:
    """num / den to six places, null over zero."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)
