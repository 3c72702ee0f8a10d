"""The vault source and sink: round trips, filters, failures, streams."""

import os

import pytest
from pyspark.sql import functions as F

from lexigraph.sources import vault


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    vault.register(spark)


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path = path.with_name(path.name + ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def read(spark, root):
    return {r.path: r.contents for r in spark.read.format("vault").load(str(root)).collect()}


def test_reads_markdown_only(spark, tmp_path):
    put(tmp_path, a="one\r\n", sub__b="été 😀", sub__deep__c="")
    put(tmp_path, **{".obsidian__x": "no", "sub__.git__y": "no"})
    (tmp_path / "z.txt").write_text("no")
    (tmp_path / "Q.MARKDOWN").write_text("yes")
    want = {"a.md": "one\r\n", "sub/b.md": "été 😀", "sub/deep/c.md": "", "Q.MARKDOWN": "yes"}
    assert read(spark, tmp_path) == want and read(spark, f"file://{tmp_path}") == want
    assert read(spark, tmp_path / "nothing") == {}


def test_filters_skip_folders(spark, tmp_path):
    for i in range(5):
        put(tmp_path, **{f"f{i}__n{j}": f"{i} {j}" for j in range(3)})
    r = vault.VaultReader({"path": str(tmp_path)})
    left = list(r.pushFilters([vault.StringStartsWith(("path",), "f3/"), vault.EqualTo(("contents",), "x")]))
    assert len(left) == 1 and sorted(f for p in r.partitions() for f in p.files) == [f"f3/n{j}.md" for j in range(3)]
    df = spark.read.format("vault").load(str(tmp_path))
    assert sorted(x.path for x in df.where("path like 'f2/%'").collect()) == [f"f2/n{j}.md" for j in range(3)]
    assert [x.contents for x in df.where("path in ('f4/n1.md', 'gone.md')").collect()] == ["4 1"]
    assert df.where("path = 'f1/n0.md' and contents = 'other'").count() == 0


def test_splits_by_folders(tmp_path):
    for i in range(70):
        put(tmp_path, **{f"f{i}__deep__n": "x"})
    parts = vault.VaultReader({"path": str(tmp_path)}).partitions()
    assert len(parts) >= vault.SPLITS and sum(len(list(b.column(0))) for p in parts for b in vault.VaultReader({"path": str(tmp_path)}).read(p)) == 70


def test_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("contents"))
    docs.repartition(4).write.format("vault").mode("append").save(str(tmp_path))
    assert read(spark, tmp_path) == {r.path: r.contents for r in docs.collect()}
    change = spark.createDataFrame([("src1/new.md", "n"), ("src0/0.md", None), ("gone.md", None)], "path string, contents string")
    before = read(spark, tmp_path)
    change.write.format("vault").mode("append").save(str(tmp_path))
    assert read(spark, tmp_path) == {k: v for k, v in before.items() if k != "src0/0.md"} | {"src1/new.md": "n"}
    change.limit(1).write.format("vault").mode("overwrite").save(str(tmp_path))
    assert read(spark, tmp_path) == {"src1/new.md": "n"}
    assert not [n for n in os.listdir(tmp_path) if n.startswith(vault.STAGING)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    put(tmp_path, a="before")
    rows = spark.range(40).repartition(4).select(F.concat("id", F.lit(".md")).alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("contents"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("vault").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="no path below a vault"):
        spark.createDataFrame([("ok.md", "x"), ("../out.md", "x")], "path string, contents string").coalesce(1).write.format("vault").mode("append").save(str(tmp_path))
    assert read(spark, tmp_path) == {"a.md": "before"} and os.listdir(tmp_path) == ["a.md"]


def test_stream(spark, tmp_path):
    root, out, check = tmp_path / "vault", str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: spark.readStream.format("vault").load(str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    put(root, a="one", sub__b="two")
    run()
    put(root, c="three")
    put(root, a="one again")
    run()
    run()
    assert sorted((r.path, r.contents) for r in spark.read.parquet(out).collect()) == [("a.md", "one"), ("a.md", "one again"), ("c.md", "three"), ("sub/b.md", "two")]


def test_no_list_of_files_is_held(tmp_path, monkeypatch):
    """the driver held every file's name in a read's parts, in what writing tasks
    told it, and in moves waiting for their turn."""
    import pickle

    root = tmp_path / "v"
    rows = [{"path": f"f{i % 3}/n{i}.md" if i % 2 else f"n{i}.md", "contents": str(i)} for i in range(3000)]
    writer = vault.VaultWriter({"path": str(root)}, False)
    told = [writer.write(iter(rows[:2000])), writer.write(iter([*rows[2000:], {"path": "gone.md", "contents": None}, {"path": "n0.md", "contents": None}]))]
    assert len(pickle.dumps(told)) < 1000
    put(root, gone="x")
    waiting = []
    pool_map = vault.ThreadPoolExecutor.map
    monkeypatch.setattr(vault.ThreadPoolExecutor, "map", lambda self, f, some: waiting.append(len(some)) or pool_map(self, f, some))
    writer.commit(told)
    assert max(waiting) <= vault.FILES and len(waiting) > 5
    monkeypatch.setattr(vault, "HELD", 1000)
    r = vault.VaultReader({"path": str(root)})
    parts = r.partitions()
    assert len(pickle.dumps(parts)) < 30_000 and any(p.share for p in parts)
    batches = [b for p in parts for b in r.read(p)]
    got = [x for b in batches for x in zip(b["path"].to_pylist(), b["contents"].to_pylist(), strict=True)]
    assert sorted(got) == sorted((x["path"], x["contents"]) for x in rows) and max(b.num_rows for b in batches) <= vault.FILES
    put(root, later="x")
    again = vault.VaultWriter({"path": str(root)}, True)
    again.commit([again.write(iter(rows[:5])), None])
    assert sorted(n for p in r.partitions() for n in r._names(p)) == sorted(x["path"] for x in rows[:5])
