"""Run folders, versioned stores, specs, and streams."""

import pytest
from pyspark.sql import functions as F

from tesserax.sources import logs
from tesserax.sources.database import Store, TransactionError
from tesserax.sources.runstore import RunError, find, manifest, merge_runs, read_run, validate, write_run
from tesserax.spec import DISPATCH, Database, SpecError, Table
from tesserax.streaming import latest


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v string, flag int, lsn long")


def test_runs(spark, tmp_path):
    at = lambda n: f"file:{tmp_path}/{n}"
    m = write_run(spark, entries(spark, ("b", "2", 0, 7), ("a", "1", 0, 3), ("c", None, 1, 9)), at("one"))
    assert (m.entries, m.min_lsn, m.max_lsn, m.first_key, m.last_key, m.tombstones) == (3, 3, 9, "a", "c", 1)
    assert manifest(spark, at("one")) == m and validate(spark, at("one")) is None
    assert [tuple(r) for r in find(spark, at("one"), "c").collect()] == [("c", "", 1, 9)] and find(spark, at("one"), "zz").count() == 0
    for bad in ([("a", "x", 0, 1), ("a", "y", 0, 2)], [(None, "x", 0, 1)], [("a", "x", 4, 1)]):
        with pytest.raises(RunError):
            write_run(spark, entries(spark, *bad), at("bad"))
    with pytest.raises(RunError):
        write_run(spark, entries(spark, ("a", "x", 0, 1)).limit(0), at("empty"))
    write_run(spark, entries(spark, ("a", "old", 0, 1), ("c", "live", 0, 2), ("d", "4", 0, 1)), at("two"))
    merged = merge_runs(spark, [at("one"), at("two")], at("out"), drop_tombstones=True)
    assert merged.entries == 3 and {r.k: r.v for r in read_run(spark, at("out")).collect()} == {"a": "1", "b": "2", "d": "4"}
    with pytest.raises(RunError):
        merge_runs(spark, [], at("none"))
    with pytest.raises(RunError):
        read_run(spark, at("nowhere"))


def test_store_is_all_or_nothing(spark, tmp_path):
    path = f"file:{tmp_path}/db"
    db = Store.create(spark, path, DISPATCH)
    with pytest.raises(SpecError):
        Store.create(spark, path, DISPATCH)
    tx = db.begin()
    with pytest.raises(TransactionError):
        db.begin()
    tx.put("orders", spark.createDataFrame([(1, "new|high")], "k long, v string"))
    tx.put("due", spark.createDataFrame([(1,)], "k long"))
    assert db.table("orders").count() == 0 and tx.table("orders").count() == 1
    tx.commit()
    assert db.table("orders").count() == 1 and db.table("due").count() == 1
    with pytest.raises(TransactionError):
        tx.commit()
    tx = db.begin()
    tx.put("orders", tx.table("orders").limit(0))
    tx.rollback()
    assert Store.open(spark, path, DISPATCH).table("orders").count() == 1
    tx = db.begin()
    tx.put("due", spark.createDataFrame([(5,)], "k long"))
    tx.put("orders", spark.createDataFrame([(5, "x")], "k long, v string").withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    with pytest.raises(Exception, match="stop"):
        tx.commit()
    assert db.table("due").count() == 1 and [r.k for r in db.table("due").collect()] == [1]
    tx = db.begin()
    tx.put("due", tx.table("due").union(spark.createDataFrame([(2,)], "k long")))
    tx.commit()
    assert db.table("due").count() == 2 and db.table("orders").count() == 1
    with pytest.raises(SpecError):
        Store.open(spark, path, DISPATCH.add(Table("more", "log", (("k", "int"),))))


def test_specs():
    ok = Table("t", "map", (("k", "bigint"), ("v", "string")))
    assert Database().add(ok).fingerprint() != Database().add(Table("t", "map", ok.columns, version=2)).fingerprint()
    with pytest.raises(SpecError):
        Database().add(ok).add(ok)
    for name in ("", "$x", "a.$b", "a\0b", "x" * 256):
        with pytest.raises(SpecError):
            Table(name, "map", ok.columns)
    for settings in ((), (("dimensions", 0), ("coordinate", "int")), (("dimensions", 2), ("coordinate", "uint"))):
        with pytest.raises(SpecError):
            Table("b", "boxes", ok.columns, settings=settings)
    for kind, columns in (("heap", ok.columns), ("map", (("k", "uint"),)), ("map", (("k", "int"), ("k", "int")))):
        with pytest.raises(SpecError):
            Table("t", kind, columns)


def test_stream_of_versions(spark, tmp_path):
    at = lambda n: f"file:{tmp_path}/{n}"
    schema = "k string, v string, flag int, lsn long, run int"
    go = lambda: latest.fold(spark.readStream.schema(schema).parquet(at("in")), at("state"), at("check")).awaitTermination()
    write = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(at("in"))
    write(("a", "1", 0, 5, 0), ("b", "1", 0, 5, 1))
    go()
    write(("a", "late", 0, 3, 0), ("b", "tie", 0, 5, 0), ("c", "", 1, 1, 0))
    go()
    assert {r.k: r.v for r in latest.latest(spark, at("state")).collect()} == {"a": "1", "b": "tie", "c": ""}


def test_log_folder(spark, tmp_path):
    path = f"file:{tmp_path}/log"
    for seq in (0, 1):
        logs.append(spark.createDataFrame([(seq, "page", 1, "i", None, False)], logs.SCHEMA), path)
    assert logs.read(spark, path).count() == 2 and logs.follow(spark, path).isStreaming


def test_windowed_counts_with_lateness(spark, tmp_path):
    at = f"file:{tmp_path}/events"
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'")
    rows.write.parquet(at)
    stream = latest.counts_by_window(spark.readStream.schema(rows.schema).parquet(at))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
