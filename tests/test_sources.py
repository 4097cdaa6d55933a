import pytest
from pyspark.sql import functions as F

from lodestone.sources.extract import markup_declarations, read_files, verified
from lodestone.sources.store import GenerationStore, StoreError, incremental

STEPS = ["leased", "written", "verified", "described", "renamed", "pointed"]


def rows(spark, n):
    return spark.createDataFrame([(i, f"t{i}") for i in range(n)], "k long, v string")


def test_publish_open_and_time_travel(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError) as e:
        store.open()
    assert e.value.code == "NOT_FOUND"
    a = store.publish(rows(spark, 3), key=["k"])
    assert store.publish(rows(spark, 3).repartition(5)).generation == a.generation
    b = store.publish(rows(spark, 4))
    assert store.open().count() == 4 and store.open(a.generation).count() == 3
    assert store.generations() == sorted([a.generation, b.generation]) and store.validate() == "valid"
    with pytest.raises(StoreError) as e:
        store.publish(rows(spark, 2).union(rows(spark, 2)), key=["k"])
    assert e.value.code == "DUPLICATE_KEY" and store.current() == b.generation


@pytest.mark.parametrize("step", STEPS)
def test_a_fault_leaves_a_whole_generation_current(spark, tmp_path, step):
    store = GenerationStore(spark, str(tmp_path / "s"))
    first = store.publish(rows(spark, 2))

    def fault(at):
        if at == step:
            raise OSError(at)

    with pytest.raises(OSError):
        store.publish(rows(spark, 5), fault=fault)
    assert store.validate() == "valid"
    assert (store.current() == first.generation) == (step != "pointed")
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_tmp")]
    assert store.publish(rows(spark, 5)).rows == 5


def test_parts_are_published_together_or_not_at_all(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    whole = store.publish(rows(spark, 5))
    seen = []

    def more(first):
        for k in (1, 2):
            seen.append(first.count())
            yield first.select("v", (F.col("k") + k * 2).alias("k")).withColumn("v", F.concat(F.lit("t"), "k")).where("k < 5 and k > 1" if k == 1 else "k = 4")

    made = store.publish(rows(spark, 2), more=more)
    assert made.generation == whole.generation and seen == [2, 2] and store.validate() == "valid"

    def broken(first):
        yield first
        raise OSError("part")

    with pytest.raises(OSError):
        store.publish(rows(spark, 3), more=broken)
    assert store.current() == whole.generation
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_tmp")]


def test_one_writer_at_a_time(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    store.publish(rows(spark, 1))
    (tmp_path / "s" / "_lease").write_text("held")
    with pytest.raises(StoreError) as e:
        store.publish(rows(spark, 2), wait=0.1)
    assert e.value.code == "BUSY"


def test_damage_is_found(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    held = store.publish(rows(spark, 2))
    rows(spark, 1).write.mode("append").parquet(f"{tmp_path}/s/{held.generation}/data")
    assert store.validate() == "corrupt" and store.validate("gen_none") == "missing"


def test_incremental_reads_only_what_changed(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("gone", "3", "z")], "path string, digest string, name string")
    files = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "4")], "path string, digest string")
    seen = []

    def extract(df):
        seen.extend(r.path for r in df.collect())
        return df.withColumn("name", F.concat(F.lit("new "), "path"))

    got = {tuple(r) for r in incremental(old, files, extract).collect()}
    assert sorted(seen) == ["b", "c"] and got == {("a", "1", "x"), ("b", "9", "new b"), ("c", "4", "new c")}


def test_files_are_decoded_and_verified(spark, tmp_path):
    (tmp_path / "obj").mkdir()
    (tmp_path / "obj" / "no.txt").write_bytes(b"x")
    (tmp_path / "a.txt").write_bytes("é\r\n👋".encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfx\n")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    found = read_files(spark, str(tmp_path), "*.txt").withColumn("name", F.substring_index("path", "/", -1))
    got = {r.name: (r.encoding, r.newline, r.text) for r in found.collect()}
    assert got == {"a.txt": ("utf-8", "crlf", "é\r\n👋"), "b.txt": ("utf-8-bom", "lf", "x\n"), "c.txt": ("binary", "none", None)}
    manifest = found.select("path", F.when(F.col("name") == "b.txt", "old").otherwise(F.col("digest")).alias("digest")).union(spark.createDataFrame([("lost", "d")]))
    status = {r.path.split("/")[-1]: (r.status, r.text) for r in verified(manifest, found).collect()}
    assert status == {"a.txt": ("verified", "é\r\n👋"), "b.txt": ("stale", None), "c.txt": ("verified", None), "lost": ("missing", None)}


def test_markup_spans(spark):
    df = spark.createDataFrame([(1, "<p>a<b>x</b>\n<br></p><i>"), (2, None), (3, "plain")], "id long, html string")
    got = {(r.name, r.start, r.end, r.depth) for r in markup_declarations(df, "id").collect()}
    assert got == {("b", 4, 12, 1), ("br", 13, 17, 1), ("p", 0, 21, 0)}


def test_revision_source(spark, tmp_path):
    import subprocess

    from lodestone.sources.versions import register

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a b.txt").write_bytes(b"one\r\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "c.txt").write_bytes(b"two")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "a b.txt").write_bytes(b"changed")
    git("commit", "-qam", "second")
    register(spark)
    read = lambda r: spark.read.format("revision").option("root", str(tmp_path)).option("revision", r).load()
    assert {(r.path, bytes(r.content)) for r in read("HEAD").collect()} == {("a b.txt", b"changed"), ("d/c.txt", b"two")}
    assert {(r.path, bytes(r.content)) for r in read("HEAD~1").where("path = 'a b.txt'").collect()} == {("a b.txt", b"one\r\n")}
