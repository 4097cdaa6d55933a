"""Personal data by rules, and by bootstrapped context patterns that the rules' finds induce. DataFrame and SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import apart, joined_apart, settled, table

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. A run of characters can only match from its start or from where the last match ended, so nothing is tried twice:
#: `\G` and the look-behind keep the leftmost matches as they are and the time linear.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
NEEDS = {"email": "@", "phone": "+"}
#: Candidates of the patterns: words with a digit or @, and groups of digits that follow them.
CANDIDATE = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+(?:\x20[(0-9][0-9().-]*+)*+"
#: Characters of context on each side that patterns are made of.
CONTEXT = 64
STEP, SHORT = 256, 16
#: Scoring ends with the first round that changes no confidence by more.
SETTLED = 0.02


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once, not anew wherever a lambda names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _runs(x: Column, step: int = STEP) -> Column:
    """An array in runs of `step`; of an empty one the runs are empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda b: F.slice(x, b * step + 1, step))


def running(lengths: Column) -> Column:
    """Sums of all elements before each: by runs of STEP, so that long arrays don't cost the square of their length."""

    def sums(part: Column, start: Column) -> Column:
        # the result is start, start + x0, ...: one more than the part has
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def over(xs: Column) -> Column:
        runs = _runs(xs)
        starts = sums(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + x)), F.lit(0))
        # zipped rather than looked up, so that nothing is worked out anew for each run
        parts = F.zip_with(runs, F.slice(starts, 1, F.size(runs)), lambda r, s: F.slice(sums(r, s), 1, F.size(r)))
        return F.flatten(parts)

    return _let(lengths, over)


def matches(df: DataFrame, name: str, pattern: str, needed: Column, sides: bool = False) -> DataFrame:
    """Adds an array of (start, end, match) of the leftmost matches in `text`, in code points; with sides, the text beside each."""
    gaps, hits, before = f"_{name}_gaps", f"_{name}_hits", f"_{name}_before"
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(needed, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.split("text", pattern, -1)).otherwise(none))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    df = df.withColumn(before, F.when(some, running(lengths)).otherwise(F.array().cast("array<int>")))

    def one(m: Column) -> Column:
        start = (m["before"] + F.length(m["left"])).alias("start")
        parts = [start, (start + F.length(m["hit"])).alias("end"), m["hit"].alias("match")]
        if sides:
            parts += [F.right(m["left"], F.lit(CONTEXT)).alias("left"), F.left(m["right"], F.lit(CONTEXT)).alias("right")]
        return F.struct(*parts)

    n = F.size(hits)
    each = F.arrays_zip(F.col(hits).alias("hit"), F.col(before).alias("before"), F.slice(gaps, 1, n).alias("left"), F.slice(gaps, 2, n).alias("right"))
    return df.withColumn(name, F.transform(each, one)).drop(gaps, hits, before)


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds base: array of (start, kind, end), kind a place in KINDS, ordered by start, then kind."""
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        need = F.contains(F.col("text"), F.lit(NEEDS[kind])) if kind in NEEDS else digit
        df = matches(df, f"_{kind}", RULES[kind], need)
    def kept(k: int, kind: str) -> Column:
        span = lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))
        return F.transform(F.filter(f"_{kind}", lambda m: _holds(kind, m["match"])), span)

    spans = [kept(k, kind) for k, kind in enumerate(KINDS)]
    return df.withColumn("base", F.sort_array(F.concat(*spans))).drop(*(f"_{k}" for k in KINDS))


def _edge_word(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, pattern, group)), "[0-9]+", "0"), r"[^\p{L}0=:#]+", " ")


def candidates(df: DataFrame) -> DataFrame:
    """Adds cands: array of (start, end, match, seed, patterns) of texts with a digit or @; seed is the kind of a base span it overlaps.

    Patterns: the two words before it, and the words on both sides, lower-cased, digits as 0.
    """
    df = matches(df, "_cand", CANDIDATE, F.col("text").rlike("[0-9@]"), sides=True)

    def bounded(run: Column) -> Column:
        return F.struct(run.alias("spans"), F.try_element_at(run, F.lit(1))["start"].alias("low"), F.array_max(F.transform(run, lambda b: b["end"])).alias("high"))

    def overlapping(runs: Column, start: Column, end: Column) -> Column:
        near = F.filter(runs, lambda r: (r["low"] < end) & (r["high"] > start))
        return F.flatten(F.transform(near, lambda r: F.filter(r["spans"], lambda b: (b["start"] < end) & (b["end"] > start))))

    def each(run: Column, runs: Column) -> Column:
        """A run of candidates looks at the spans beside it only, and each of them at short runs of these."""
        beside = overlapping(runs, F.try_element_at(run, F.lit(1))["start"], F.try_element_at(run, F.lit(-1))["end"])
        return _let(beside, lambda own: _let(F.transform(_runs(own, SHORT), bounded), lambda few: F.transform(run, lambda c: one(c, few))))

    def one(c: Column, runs: Column) -> Column:
        over = overlapping(runs, c["start"], c["end"])
        skipped = F.length(F.regexp_extract(c["match"], r"^[^\p{L}0-9+(]*+", 0))
        rest = F.substring(c["match"], skipped + 1, F.length(c["match"]))
        word = F.left(rest, F.length(rest) - F.length(F.regexp_extract(F.reverse(rest), r"^[^\p{L}0-9]*+", 0)))
        start = (c["start"] + skipped).alias("start")
        two = _edge_word(c["left"], r"(\S+\s+\S+)\s*$", 1)
        last, first = _edge_word(c["left"], r"(\S+)\s*$", 1), _edge_word(c["right"], r"^\s*(\S+)", 1)
        named = F.array(F.when(F.trim(two) != "", F.concat(F.lit("before "), two)), F.when((F.trim(last) != "") & (F.trim(first) != ""), F.concat_ws(" # ", last, first)))
        seed = F.try_element_at(F.transform(over, lambda b: b["kind"]), F.lit(1)).alias("seed")
        return F.struct(start, (start + F.length(word)).alias("end"), word.alias("match"), seed, F.filter(named, lambda p: p.isNotNull()).alias("patterns"))

    found = _let(F.transform(_runs(F.col("base")), bounded), lambda runs: F.flatten(F.transform(_runs(F.col("_cand")), lambda run: each(run, runs))))
    return df.withColumn("cands", F.filter(found, lambda c: c["end"] > c["start"])).drop("_cand")


def bootstrap(edges: DataFrame, support: float = 3.0, accept: float = 0.8, settles: float = SETTLED) -> DataFrame:
    """Scores the graph of patterns and instances: returns (match, kind) of unseen instances that are accepted.

    edges: (pattern, match, seed), distinct. A pattern's confidence for a kind is the sum of its instances' confidences over one more than
    their number, none below `support`; an instance that no rule found has the noisy-or of its patterns. Seeds
    stay at 1 for their kind, 0 for others. No confidence ever falls, so rounds come to rest; the last is the first that moves none by more than
    `settles`. Both sides are group-by sums, which are pre-aggregated; a hot pattern's or instance's links are not dealt to one
    task for the joins either: which are hot is found out once.
    """
    cols = [f"c{k}" for k in range(len(KINDS))]
    seeds = edges.groupBy("match").agg(*(F.max(F.when(F.col("seed") == k, 1.0).otherwise(0.0)).alias(c) for k, c in enumerate(cols)), F.max(F.col("seed").isNotNull()).alias("known"))
    seeds, links = settled(seeds), settled(edges.select("pattern", "match").distinct())
    by_match = apart(links, "match")
    # what seeds give their patterns stays, so rounds look at the other instances only
    given = joined_apart(by_match, seeds.where("known").drop("known"), "match").groupBy("pattern").agg(*(F.sum(c).alias(c) for c in cols))
    number = links.groupBy("pattern").agg(*(F.lit(0.0).alias(c) for c in cols), F.count("*").alias("n"))
    fixed = given.withColumn("n", F.lit(0).cast("long")).unionByName(number)
    fixed = settled(fixed.groupBy("pattern").agg(*(F.sum(c).alias(c) for c in (*cols, "n"))))
    open_ = settled(joined_apart(by_match, seeds.where(~F.col("known")).select("match"), "match").select("pattern", "match"))
    by = {key: apart(open_, key) for key in ("match", "pattern")}
    now, moved = seeds.select("match", *cols).limit(0), math.inf
    while moved > settles:
        added = joined_apart(by["match"], now, "match").groupBy("pattern").agg(*(F.sum(c).alias(c) for c in cols)).withColumn("n", F.lit(0).cast("long"))
        by_pattern = fixed.unionByName(added).groupBy("pattern").agg(*(F.sum(c).alias(c) for c in (*cols, "n")))
        by_pattern = by_pattern.select("pattern", *(F.when(F.col(c) >= support, F.col(c) / (F.col("n") + 1)).otherwise(0.0).alias(c) for c in cols))
        strong = by_pattern.where(reduce(lambda a, b: a | b, (F.col(c) > 0 for c in cols)))
        reached = joined_apart(by["pattern"], settled(strong), "pattern").groupBy("match").agg(*((1 - F.exp(F.sum(F.log1p(-F.col(c))))).alias(f"n{c}") for c in cols))
        change = F.greatest(*(F.abs(F.col(f"n{c}") - F.coalesce(c, F.lit(0.0))) for c in cols))
        again = settled(reached.join(now.hint("merge"), "match", "left").select("match", *(F.col(f"n{c}").alias(c) for c in cols), change.alias("moved")))
        moved = again.agg(F.max("moved")).first()[0] or 0.0
        now = again.drop("moved")
    best = F.greatest(*cols)
    kind = reduce(lambda rest, k: F.when(F.col(cols[k]) == best, k).otherwise(rest), reversed(range(len(cols))), F.lit(None).cast("int"))
    return now.where(best >= accept).select("match", kind.alias("kind"))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row (null text: empty), base and spans: arrays of (start, kind, end) by start, then kind.

    base has what the rules find; spans has those and the occurrences of identifiers that only confident context patterns reach.
    Patterns and instances are scored over all documents. Null ids stay; rows that repeat come as often; an empty table gives none;
    columns beyond those kept are ignored.
    """
    own = docs.select(*(F.col(c).alias(f"_doc_{c}") for c in keep), F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(base_spans(own.withColumn("row", F.monotonically_increasing_id())))
    found = settled(found.drop("text"))  # row numbers and spans are fixed from here on
    each = found.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "match", "seed").distinct()
    unseen = bootstrap(edges)
    new = joined_apart(each.where("seed is null"), settled(unseen), "match").select("row", F.struct("start", "kind", "end").alias("span"))
    by_row = new.groupBy("row").agg(F.collect_set("span").alias("added"))  # at most the candidates of one text
    some = found.where(F.size("cands") > 0).join(by_row, "row", "left")
    names = [F.col(f"_doc_{c}").alias(c) for c in keep]
    whole = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(found.schema["base"].dataType))))
    return found.where(F.size("cands") == 0).select(*names, "base", F.col("base").alias("spans")).unionByName(some.select(*names, "base", whole.alias("spans")))


def joined(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: str) -> Column:
    """The text with its spans, ordered by start, replaced by [EMAIL], [IP], ...; of spans that overlap the first gives the name, and all are covered.

    Time is in proportion to the text and the number of spans, but for a factor of STEP: runs of spans look at their part of the text only.
    """
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def reach(run: Column, start: Column) -> Column:
        """start, and then the greatest end up to and with each span."""
        return F.aggregate(run, F.array(start), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"]))))

    def heads(all_: Column) -> Column:
        """(start, kind, prev) of spans that begin beyond all ends before, prev the last of these."""
        runs = _runs(all_)
        starts = lambda highs: F.transform(highs, lambda _, i: F.array_max(F.concat(F.array(F.lit(0)), F.slice(highs, 1, i))))
        from_ = _let(F.transform(runs, lambda r: F.array_max(F.transform(r, lambda s: s["end"]))), starts)
        marked = F.zip_with(runs, from_, lambda r, a: F.zip_with(r, F.slice(reach(r, a), 1, F.size(r)), lambda s, p: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), p.alias("prev"))))
        return F.filter(F.flatten(marked), lambda h: h["start"] >= h["prev"])

    def piece(part: Column, base: Column, h: Column) -> Column:
        return F.concat(F.substring(part, h["prev"] - base + 1, h["start"] - h["prev"]), F.element_at(kind, h["kind"] + 1))

    def joined_run(run: Column) -> Column:
        base, last = F.element_at(run, 1)["prev"], F.element_at(run, -1)["start"]
        return _let(F.substring(text, base + 1, last - base), lambda part: F.array_join(F.transform(run, lambda h: piece(part, base, h)), ""))

    body = _let(heads(F.col(spans)), lambda hs: F.array_join(F.transform(_runs(hs), joined_run), ""))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(body, F.substring(text, end + 1, F.length(text))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, and all spans."""
    found = find(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
