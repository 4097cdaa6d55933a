"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, packing. Each stage's result is written and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, packing, pii, simhash
from lodestone.llm.common import settled, table
from lodestone.llm.near import near_firsts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is taken for no language if the mean marginal of its best one is below so many times an even share over all languages, or below LEAST_SCORE
#: where there are few.
OVER_EVEN, LEAST_SCORE = 1.2, 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and a number that tells rows apart whatever their ids; written once, so that it stays."""
    return settled(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no known language go; the others' lang is the predicted one.

    The model is fitted on a bounded sample of the rows whose lang is known; where no row has one, all stay as they are.
    """
    model = langid.fit(docs)
    if not model.labels:
        return docs.select(*COLUMNS)
    least = min(LEAST_SCORE, OVER_EVEN / len(model.labels))
    return langid.annotate(docs.select(*COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays if it is the first by doc_id (null last) both of its component of SimHash fingerprints (see `simhash.near_duplicates`) and of its
    group of documents whose five-word shingles are alike to 0.8 or more (see `near`).

    Fingerprints weigh repeats, the shingle sets find what lies further apart than two bits. Of rows that are equal in doc_id and text one stays. Texts
    are shuffled once, to what stays.
    """
    rows = _rows(docs)
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    named = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    firsts = rows.select("row", "doc_id").join(named.hint("merge"), "row").groupBy("of").agg(first).select("first.row")
    kept = near_firsts(rows.select("row", "doc_id", "text")).join(firsts.hint("merge"), "row", "left_semi")
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows the text. A null text stays null."""
    found = pii.find(docs, COLUMNS)
    text = F.when(F.col("text").isNull(), None).otherwise(pii.redacted(F.coalesce("text", F.lit("")), "spans"))
    changed = F.size("spans") > 0
    return found.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target takes it: 0 to 3 times."""
    rows = _rows(docs)
    mixed = mixing.mix(rows.select(F.col("row").alias("doc_id"), "text", "source"))
    times = mixed.where("taken > 0").select(F.col("doc_id").alias("row"), F.expr("cast(taken div size as int)").alias("times"))
    return rows.join(times.hint("merge"), "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The stages learn, hash and tokenise: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = settled(docs)
    return docs
