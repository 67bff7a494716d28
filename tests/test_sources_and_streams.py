"""File formats and streaming jobs."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from geoquarry.sources import files, qa
from geoquarry.streaming import jobs


def test_wrapped_and_flat_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": 1, "active": True}, {"id": 2, "active": False}, {"id": 3}]}, indent=1))
    got = qa.read_split(spark, str(tmp_path / "q.json"), "questions", "id long, active boolean")
    assert [r["id"] for r in got.orderBy("id").collect()] == [1, 3]
    (tmp_path / "c.json").write_text(json.dumps([{"image_id": "a", "x": 1}, {"image_id": "b"}], indent=1))
    assert qa.read_annotations(spark, str(tmp_path / "c.json"), "image_id string").count() == 2


def test_manifest_documents(spark, tmp_path):
    doc = {"dataset": "d", "split": "s", "tier": "t", "root": "r", "source_urls": ["u"], "retrieved_utc": "z", "extra": 1,
           "files": [{"path": "p", "bytes": 3, "sha256": "x"}], "counts": {"rows": 4}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "e.json").write_text(json.dumps({"dataset": "e", "files": []}, indent=2))
    heads, entries = files.read_manifest_documents(spark, str(tmp_path))
    got = {r["dataset"]: r for r in heads.collect()}
    assert got["d"]["error"] is None and got["d"]["counts"] == {"rows": 4}
    assert got["e"]["error"] == "manifest missing required field(s): split,tier,root,source_urls,retrieved_utc"
    assert [tuple(r) for r in entries.collect()] == [("d", "p", 3, "x")]


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = files.list_files(spark, str(tmp_path / "*.bin"), tmp_path.name).first()
    assert (row["path"], row["bytes"], row["sha256"][:8]) == ("a.bin", 3, "ba7816bf")


def day(spark, folder, number, rows):
    schema = "event_id long, ts timestamp, user_id long, value double"
    start = datetime.datetime(2024, 1, number)
    data = [(i, start + datetime.timedelta(minutes=m), u, v) for i, m, u, v in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return jobs.read_events(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1)


def test_streams_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "events")
    day(spark, folder, 1, [(1, 0, 7, 0.1), (2, 5, 7, 0.4), (3, 10, 8, 0.2)])
    day(spark, folder, 2, [(4, 0, 7, 0.9), (5, 1, 8, 0.1)])
    day(spark, folder, 3, [(6, 0, 7, 0.5)])
    end = jobs.Closing(spark, datetime.datetime(2024, 1, 9))
    events = jobs.read_events(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1, closing=end)
    masks = events.select(F.col("user_id").alias("location"), "ts", F.col("value").alias("fraction"))
    got = jobs.run_once(jobs.change_state(masks), "t", closing=end).orderBy("location", "ts").collect()
    deltas = [None if r["delta"] is None else round(r["delta"], 6) for r in got]
    assert deltas == [None, 0.3, 0.5, -0.4, None, -0.1]
    runs = stream(spark, folder).select("ts", "user_id", F.lit("vqa").alias("task"), F.lit("success").alias("status"))
    windows = jobs.run_once(jobs.counts_per_window(runs), "w").orderBy("start").collect()
    assert [r["runs"] for r in windows] == [3, 2]
    twice = stream(spark, folder).select(F.col("event_id").alias("qid"), "ts").unionByName(
        stream(spark, folder).select(F.col("event_id").alias("qid"), "ts"))
    assert jobs.run_once(jobs.drop_repeats(twice), "d").count() == 6


def test_a_hot_location_comes_out_in_order_of_time(spark, tmp_path):
    # one location sends nearly everything, out of order within a trigger and across triggers
    folder, rng = str(tmp_path / "hot"), random.Random(2)
    start, rows = datetime.datetime(2024, 1, 1), []
    for trigger in range(5):
        some = [(trigger * 300 + i, trigger * 60 + rng.randint(-5, 59), 7 if i % 30 else 8, round(rng.random(), 3)) for i in range(300)]
        rows += some
        data = [(i, start + datetime.timedelta(minutes=max(0, m)), u, v) for i, m, u, v in some]
        spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(folder)
    end = jobs.Closing(spark, datetime.datetime(2024, 1, 9))
    events = jobs.read_events(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1, closing=end)
    masks = events.select(F.col("user_id").alias("location"), "ts", F.col("value").alias("fraction"))
    got = jobs.run_once(jobs.change_state(masks, "70 minutes"), "hot", closing=end).collect()
    for user in (7, 8):
        want = sorted((max(0, m), v) for _, m, u, v in rows if u == user)
        own = sorted((r["ts"], r["fraction"]) for r in got if r["location"] == user)
        assert [v for _, v in own] == [v for _, v in want]
        steps = sorted(round(b - a, 6) for (_, a), (_, b) in zip(want, want[1:]))
        assert sorted(round(r["delta"], 6) for r in got if r["location"] == user and r["delta"] is not None) == pytest.approx(steps)


def test_a_span_of_days_arrives_in_so_many_files_whatever_the_input(spark, tmp_path):
    import glob

    rows = spark.range(0, 600, 1, 6).selectExpr("id", "IF(id = 0, NULL, timestamp'2024-01-03 12:00:00' + make_dt_interval(id % 3 * 8)) ts")
    days = 8
    folder = str(tmp_path / "arrivals")
    assert jobs.arrivals(rows, folder, days, pieces=2) == rows.schema
    files = sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)
    # six input partitions and spans of 8 days: two files each, in the order of the spans
    spans = [{r["d"] for r in spark.read.parquet(f).selectExpr("unix_date(to_date(ts)) DIV 8 d").collect()} for f in files]
    assert len(files) == 6 and all(len(s) == 1 for s in spans)
    assert [min(s) for s in spans] == sorted(min(s) for s in spans)
    assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == list(range(1, 600))
    jobs.arrivals(rows.limit(0), str(tmp_path / "none"), days, pieces=2)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def masks_arriving(spark, folder):
    """1,500 locations, two ids that doubles cannot hold and none, three days of arrivals in three triggers."""
    big, rows = 2**53, []
    for d in (1, 2, 3):
        some = [(1, m, u, (u % 11 + d) / 16) for m, u in enumerate([*range(1500), big, big + 1])]
        some += [(2, m, None, (m + d) / 16) for m in (0, 3)]
        day(spark, folder, d, some)
        rows += [(u, datetime.datetime(2024, 1, d) + datetime.timedelta(minutes=m), v) for _, m, u, v in some]
    return rows


def test_a_missing_location_is_one_location_and_takes_no_other(spark, tmp_path):
    folder = str(tmp_path / "nowhere")
    rows = masks_arriving(spark, folder)
    end = jobs.Closing(spark, datetime.datetime(2024, 1, 9))
    events = jobs.read_events(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1, closing=end)
    masks = events.select(F.col("user_id").alias("location"), "ts", F.col("value").alias("fraction"))
    got = jobs.run_once(jobs.change_state(masks, "2 days"), "nowhere", closing=end).collect()
    want, last = [], {}
    for u, ts, v in sorted(rows, key=lambda r: r[1]):
        want.append((u, ts, v, v - last[u] if u in last else None))
        last[u] = v
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_state_goes_by_groups_of_locations(spark, tmp_path):
    folder = str(tmp_path / "many")
    masks_arriving(spark, folder)
    five = F.explode(F.sequence(F.col("user_id") * 5, F.col("user_id") * 5 + 4)).alias("location")
    masks = stream(spark, folder).where("user_id < 1500").select(five, "ts", F.col("value").alias("fraction"))
    writer = jobs.change_state(masks, "1 day").writeStream.format("noop").outputMode("append")
    run = writer.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    run.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    # what waits, the last masks, a timer and its index entry
    assert 0 < max(kept) <= 4 * (jobs.GROUPS + 1)
