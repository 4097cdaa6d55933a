from pyspark.sql import functions as F

from lodestone.functions import text as tx


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_positions_count_utf16_units(spark):
    x = F.col("x")
    assert one(spark, "a👋b", tx.utf16_length(x), tx.utf16_slice(x, 1, 2), tx.utf16_slice(x, 3, 1)) == (4, "👋", "b")
    df = spark.createDataFrame([("\ue000",), ("！",), ("👋",)], "x string")
    assert [r.x for r in df.orderBy(tx.ordinal(x)).collect()] == ["👋", "\ue000", "！"]


def test_lines_end_at_any_break(spark):
    x = F.col("x")
    for value, n in (("", 0), ("a", 1), ("a\n", 2), ("a\r\nb\rc\nd", 4)):
        assert one(spark, value, tx.line_count(x), F.size(tx.lines(x))) == (n, n)
    df = spark.createDataFrame([("a\r\nb", i) for i in range(5)], "x string, i int")
    assert [r[0] for r in df.select(tx.line_of(x, F.col("i"))).collect()] == [1, 1, 1, 2, 2]
    for value, kind in (("a\r\nb\n", "crlf"), ("a\nb\r", "lf"), ("a\rb", "cr"), ("", "none")):
        assert one(spark, value, tx.newline_class(x)) == (kind,)


def test_space_of_any_kind_goes(spark):
    assert one(spark, " a\u00a0\u3000\tb ", tx.strip_space(F.col("x"))) == ("ab",)


def test_ids_tell_tuples_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "a string, b string")
    ids = [r[0] for r in df.select(tx.entity_id("sym", F.col("a"), F.col("b"))).collect()]
    assert len(set(ids)) == 4
    assert df.where(tx.entity_id("sym", F.col("a"), F.col("b")).rlike(tx.entity_pattern("sym"))).count() == 4


def test_parts_of_a_declaration(spark):
    x = F.col("x")
    assert one(spark, "int F() => G(); { y }", tx.header(x), tx.body(x)) == ("int F() => G();", " y ")
    assert one(spark, "int F() => 1;", tx.header(x), tx.body(x)) == ("int F()", " 1")
    assert one(spark, "a}b", tx.header(x), tx.body(x)) == ("a}b", "a}b")
    assert one(spark, "} x { y", tx.header(x), tx.body(x)) == ("} x", " y")
    assert one(spark, "f =>", tx.header(x), tx.body(x)) == ("f", "")


def test_line_starts_context_and_spans(spark):
    x = F.col("x")
    text = "a\r\nbb\rc\n"
    assert one(spark, text, tx.line_starts(x), tx.strip_break(x)) == ([0, 3, 6, 8], "a\r\nbb\rc")
    assert one(spark, text, tx.context(x, F.lit(2), F.lit(2), 1), tx.context(x, F.lit(1), F.lit(1), 0)) == (text, "a\r\n")
    valid = lambda *v: one(spark, text, tx.span_valid(x, *map(F.lit, v)))[0]
    assert valid(3, 2, 2, 2) and valid(0, 8, 1, 4) and not valid(3, 2, 1, 2) and not valid(7, 2, 3, 4) and not valid(-1, 1, 1, 1)


def test_keys_and_times(spark):
    x = F.col("x")
    key = lambda items: one(spark, "p", tx.keyed("analysis", items=tx.canonical(F.array(*map(F.lit, items))), path=F.trim(x)))[0]
    assert key(["b", " a"]) == key(["a", "b", "b"]) != key(["a"])
    assert one(spark, "a", tx.selection_key(x, F.lit(None)))[0] == one(spark, "a", tx.selection_key(x, F.lit("")))[0]
    assert str(one(spark, "2024-05-06T07:08:09+02:00", tx.utc(x))[0]) != "None" and one(spark, "2024-05-06", tx.utc(x)) == (None,)
    assert [one(spark, p, tx.generated(x))[0] for p in ("a/B.G.cs", "generated/x", "a/regenerated/x", "a.cs")] == [True, True, False, False]


def test_paths_and_numbers(spark):
    fine = {"a/b.cs": True, "a\\b": True, "../x": False, "/x": False, "C:\\x": False, "a//b": False, "": False, ".": False}
    for path, ok in fine.items():
        assert one(spark, path, tx.safe_path(F.col("x"))) == (ok,), path
    nums = spark.createDataFrame([(2.5,), (-2.5,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in nums.select(tx.rounded(F.col("x"), 0)).collect()] == [3.0, -3.0, None, None]
    share = spark.createDataFrame([(300, 360), (1, 0)], "n long, d long").select(tx.ratio(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in share] == [0.833333, None]
