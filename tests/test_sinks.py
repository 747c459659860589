"""Streams of requests and clicks, sinks that are replayed, vectors in buckets, a catalogue in a database."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from slatewise.sources import files as S
from slatewise.streaming import jobs as J

START = dt.datetime(2024, 1, 1)
REQUESTS = "request_id long, user_id long, source string, ts timestamp, items array<long>"
CLICKS = "click_id long, user_id long, item_id long, ts timestamp"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_clicks_follow_what_was_shown(spark, tmp_path):
    base = f"file://{tmp_path}"
    runs = [
        ([(1, 7, "a", at(0), [10, 11, 10]), (2, 7, "b", at(20), [10]), (3, None, "a", at(0), [10]), (4, 8, "a", at(0), []), (5, 8, "a", at(0), None), (6, 8, "c", at(0), [12])],
         [(100, 7, 10, at(25)), (101, 7, 10, at(25)), (102, 8, 12, at(31)), (103, 7, 11, at(-1)), (104, None, 10, at(5)), (105, 7, None, at(5))]),
        ([(9, 9, "z", at(10_000), [1])], [(900, 9, 2, at(10_000))]),
        ([(8, 9, "z", at(20_000), [1])], [(106, 7, 11, at(10)), (901, 9, 2, at(20_000))]),
    ]
    for requests, clicks in runs:
        spark.createDataFrame(requests, REQUESTS).coalesce(1).write.mode("append").parquet(f"{base}/r")
        spark.createDataFrame(clicks, CLICKS).coalesce(1).write.mode("append").parquet(f"{base}/c")
        r, c = J.events_stream(spark, f"{base}/r", REQUESTS, per_trigger=9), J.events_stream(spark, f"{base}/c", CLICKS, per_trigger=9)
        J.drain(J.matched_clicks(r, c), lambda b, n: J.commit_batch(b, n, f"{base}/out"), f"{base}/state")
    out = J.committed_rows(spark, f"{base}/out", "request_id long, source string, ts timestamp, position int, item_id long, click_id long, clicked_at timestamp")
    got = sorted(tuple(x) for x in out.filter("request_id < 8").select("request_id", "position", "item_id", F.coalesce("click_id", F.lit(-1))).collect())
    # click 102 came a minute too late for request 6, 103 before request 1, 106 after the watermark
    assert got == [(1, 0, 10, 100), (1, 0, 10, 101), (1, 1, 11, -1), (1, 2, 10, 100), (1, 2, 10, 101), (2, 0, 10, 100), (2, 0, 10, 101), (3, 0, 10, -1), (6, 0, 12, -1)]
    batch = J.matched_clicks(spark.createDataFrame(runs[0][0], REQUESTS), spark.createDataFrame(runs[0][1], CLICKS))
    assert sorted(tuple(x) for x in batch.select("request_id", "position", "item_id", F.coalesce("click_id", F.lit(-1))).collect()) == got


@pytest.mark.parametrize("half_way", [True, False])
def test_a_replayed_batch_counts_once(spark, tmp_path, half_way):
    base = f"file://{tmp_path}"
    rows = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") / 2).alias("value"))
    rows.repartition(5).write.parquet(f"{base}/in")
    calls = []

    def sink(batch, n):
        calls.append(n)
        if half_way and calls.count(2) == 1 and n == 2:  # files without the mark of a whole write
            batch.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/out/query=events/batch=2/attempt=1")
        else:
            J.commit_batch(batch, n, f"{base}/out")
        if n == 2 and calls.count(2) == 1:
            raise RuntimeError("lost")

    stream = J.events_stream(spark, f"{base}/in", rows.schema)
    assert J.committed_rows(spark, f"{base}/out", rows.schema).count() == 0
    with pytest.raises(StreamingQueryException):
        J.drain(stream, sink, f"{base}/state")
    before = J.committed_rows(spark, f"{base}/out", rows.schema).count()
    J.drain(stream, sink, f"{base}/state")
    assert calls == [0, 1, 2, 2, 3, 4] and before == (40 if half_way else 60)
    got = [r["event_id"] for r in J.committed_rows(spark, f"{base}/out", rows.schema).collect()]
    assert sorted(got) == list(range(100))


def test_only_buckets_with_new_ids_are_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    vectors = lambda ids, x: spark.createDataFrame([(i, [x, float(i)]) for i in ids], "item_id long, vec array<double>")
    assert S.write_vectors(vectors([], 0.0), path) == 0
    assert S.write_vectors(vectors(range(200), 0.0), path, buckets=8) == 1
    files = lambda: {f for f in (tmp_path / "vectors").rglob("*.parquet") if "data=" in str(f)}
    first = files()
    assert S.write_vectors(vectors([5, 5, 1000], 1.0), path, buckets=99) == 2
    assert first <= files()
    new = {f.parent.name for f in files() - first}
    assert 1 <= len(new) <= 2
    rows, version = S.stored_vectors(spark, path)
    got = {r["item_id"]: list(r["vec"]) for r in rows.collect()}
    want = {i: [0.0, float(i)] for i in range(200)} | {5: [1.0, 5.0], 1000: [1.0, 1000.0]}
    assert version == 2 and got == want and rows.count() == len(want)
    read = {f.split("/data=")[1].split("/part")[0] for f in rows.inputFiles()}
    assert {f.split("/")[1] for f in read if f.startswith("2/")} == new and len(read) == 8


def test_wrong_sizes_and_lost_jobs_leave_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    one = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, vec array<double>")
    S.write_vectors(one, path, buckets=4)
    for bad in ([1.0], [1.0, 2.0, 3.0], None):
        with pytest.raises(Exception, match="vector size differs"):
            S.write_vectors(spark.createDataFrame([(i, bad) for i in range(2, 9)], one.schema), path)
    # a job that wrote its files and died before the manifest
    one.withColumn("vec", F.array(F.lit(9.0), F.lit(9.0))).write.mode("overwrite").parquet(f"{path}/data=2/bucket=0")
    rows, version = S.stored_vectors(spark, path)
    assert version == 1 and [(r["item_id"], list(r["vec"])) for r in rows.collect()] == [(1, [1.0, 2.0])]
    assert S.write_vectors(spark.createDataFrame([(2, [3.0, 4.0])], one.schema), path) == 2
    rows, version = S.stored_vectors(spark, path)
    assert version == 2 and {r["item_id"]: list(r["vec"]) for r in rows.collect()} == {1: [1.0, 2.0], 2: [3.0, 4.0]}


def test_catalogue_from_a_database(spark, tmp_path):
    url = "jdbc:derby:memory:catalogue;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    items = spark.createDataFrame([(i, f"Film {i}", "Drama" if i % 2 else None) for i in range(50)], "item_id long, title string, genres string")
    items.write.jdbc(url, "films", properties=driver)
    got = S.read_catalogue_jdbc(spark, url, "films", properties=driver, bounds=(0, 50), parts=4).withColumnsRenamed({c: c.lower() for c in ("ITEM_ID", "TITLE", "GENRES")})
    assert got.rdd.getNumPartitions() == 4
    assert sorted(got.collect(), key=lambda r: r["item_id"]) == items.orderBy("item_id").collect()
    items.withColumn("year", F.lit(1)).drop("genres").withColumn("votes", F.lit(2)).write.jdbc(url, "bare", properties=driver)
    with pytest.raises(ValueError, match="genres"):
        S.read_catalogue_jdbc(spark, url, "bare", properties=driver)
    items.coalesce(1).write.csv(f"file://{tmp_path}/films", header=True)
    absent = "jdbc:derby:memory:nothing"
    got = S.read_catalogue_jdbc(spark, absent, "films", properties=driver, fallback=[f"file://{tmp_path}/none", f"file://{tmp_path}/films"])
    assert got.count() == 50 and "popularity" in got.columns
    with pytest.raises(Exception, match="nothing"):
        S.read_catalogue_jdbc(spark, absent, "films", properties=driver)


def test_backfilled_vectors_are_not_broadcast(spark, tmp_path, monkeypatch):
    from slatewise.sources import files

    plans, write = [], files.written
    monkeypatch.setattr(files, "written", lambda df, *rest: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, *rest))
    spark.createDataFrame([(1, "red gear red"), (2, "!"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    files.backfill_vectors(spark.read.parquet(f"{tmp_path}/items"), f"file://{tmp_path}/vectors", size=8)
    assert plans and not [p for p in plans if "Broadcast" in p]
    got = {r["item_id"]: r["vec"] for r in files.stored_vectors(spark, f"file://{tmp_path}/vectors")[0].collect()}
    assert sorted(got) == [1, 2, 3] and got[2] == got[3] == [0.0] * 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-9
