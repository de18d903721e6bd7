"""Versioned tables: no instant without a table, no two winners, merges equal to one pass in any cutting, interruptions."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.merge import merge_patches
from tallyloom.sources import versions
from tallyloom.streaming import incremental


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_reader_never_misses_the_table(spark, tmp_path):
    """While versions follow each other, each read sees a whole one."""
    path = str(tmp_path / "t")
    versions.publish(spark.range(100).withColumn("v", F.lit(0)), path)
    stop, seen, errors = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                found = versions.read(spark, path).groupBy("v").count().collect()
                assert len(found) == 1 and found[0]["count"] == 100
                seen.add(found[0]["v"])
            except Exception as e:
                errors.append(e)

    t = threading.Thread(target=read)
    t.start()
    for v in range(1, 6):
        versions.publish(versions.read(spark, path).withColumn("v", F.lit(v)), path)  # the input is the table itself
    stop.set()
    t.join()
    assert not errors and seen and versions.versions(spark, path) == [1, 2, 3, 4, 5, 6]
    assert versions.read(spark, path, 3).first()["v"] == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark.range(3), path)
    n, content = versions.manifest(spark, path)
    assert versions.commit(spark, path, n, content | {"by": "one"}) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, n, content | {"by": "two"})
    assert versions.manifest(spark, path)[1]["by"] == "one" and versions.read(spark, path).count() == 3
    assert [x.name for x in (tmp_path / "t" / "_commits").iterdir() if x.name.startswith("staging")] == []


def test_nothing_committed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_merges_in_any_cutting(spark, tmp_path):
    """Any order of batches that keeps a key's patches in order equals one merge; nulls overwrite, unknown keys are dropped."""
    rnd = random.Random(2)
    base = spark.range(200).selectExpr("cast(id as int) as k", "cast(id as double) as v", "'x' as note")
    patches = [(rnd.randrange(220), rnd.choice([None, 1.5, 2.5]), i) for i in range(300)]
    schema = "k int, v double, seq int"
    want = rows(merge_patches(base, spark.createDataFrame(patches, schema), "k", ["seq"]))
    for cuts in ([300], [7, 100, 100, 299, 300]):
        path = str(tmp_path / f"t{len(cuts)}")
        versions.publish(base, path, "k", 16)
        at = 0
        for n, cut in enumerate(cuts):
            part = spark.createDataFrame(patches[at:cut], schema)
            version = versions.merge(part, path, ["seq"], ("p", n))
            assert versions.merge(part, path, ["seq"], ("p", n)) == version  # the same batch again
            at = cut
        assert rows(versions.read(spark, path)) == want
        before = versions.read(spark, path).count()
        assert versions.vacuum(spark, path) >= 0 and rows(versions.read(spark, path)) == want and before == 200


def test_an_interrupted_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.publish(spark.range(50).selectExpr("id as k", "0 as v"), path, "k", 8)
    old = rows(versions.read(spark, path))
    patch = spark.range(50).selectExpr("id as k", "1 as v", "1 as seq")
    real = versions.commit

    def stops(*_):
        raise OSError("stopped between the files and the commit")

    monkeypatch.setattr(versions, "commit", stops)
    with pytest.raises(OSError):
        versions.merge(patch, path, ["seq"])
    monkeypatch.setattr(versions, "commit", real)
    assert rows(versions.read(spark, path)) == old
    versions.merge(patch.where("k = 7"), path, ["seq"])
    assert versions.read(spark, path).where("v = 1").count() == 1 and versions.vacuum(spark, path) == 1


def test_streamed_merges(spark, tmp_path):
    path, log = str(tmp_path / "t"), tmp_path / "log"
    versions.publish(spark.range(30).selectExpr("id as k", "cast(0 as double) as v"), path, "k", 4)
    for n in range(3):
        spark.createDataFrame([(n, float(n), n), (5, 10.0 + n, n)], "k long, v double, seq int").coalesce(1).write.parquet(f"{log}/n={n}")
        stream = spark.readStream.schema("k long, v double, seq int, n int").parquet(f"{log}/*")
        versions.merge_stream(stream.drop("n"), path, ["seq"], str(tmp_path / "cp")).awaitTermination()
    got = {r["k"]: r["v"] for r in versions.read(spark, path).collect()}
    assert got[5] == 12.0 and got[2] == 2.0 and len(got) == 30 and len(versions.versions(spark, path)) == 4


def test_tables_of_one_file_are_streams_too(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    [one] = (tmp_path / "t").glob("part-*")
    one.rename(tmp_path / "e.parquet")
    for path in (tmp_path / "e.parquet", tmp_path / "t2"):
        if path.name == "t2":
            spark.range(5).write.parquet(str(path))
        q = incremental.table_stream(spark, str(path)).writeStream.format("memory").queryName(f"q_{path.stem}").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"q_{path.stem}").count() == 5
