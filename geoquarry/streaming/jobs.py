"""The request-to-trace path as Structured Streaming jobs.

The reference handles one request at a time; these jobs run the same columns on
arriving rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from geoquarry.operators.catalog import inspect
from geoquarry.operators.routing import route
from geoquarry.operators.trace import write_traces
from geoquarry.session import scratch_path

LATE = "10 minutes"
#: The state store that timers and lists need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark, folder, name="events.parquet", schema=None, files_per_batch=None, closing=None, pieces=None):
    """Stream of the files called ``name`` in a folder, with ``ts`` as event time.

    ``closing`` is a :class:`Closing` whose row follows when the input has ended.
    ``pieces`` deals the rows of a trigger out to so many tasks, for inputs of few
    files; without it a file is read and worked on where it is split.
    """
    schema = schema or spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(folder)
    if closing:
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(closing.prepare(schema)))
    if pieces:
        rows = rows.repartition(pieces)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(events, folder, days, pieces=1):
    """Write ``events`` below ``folder`` as they would arrive, the files of ``days`` days after those of the days before; returns the schema.

    The days are sorted out in one pass, whatever their number, and each span becomes
    ``pieces`` files (fewer if it has fewer rows), whatever the input's size.  Rows
    without a time do not arrive.
    """
    spark, sorted_out = events.sparkSession, scratch_path(events.sparkSession, "spans")
    span = F.floor(F.unix_date(F.to_date("ts")) / days).cast("long").alias("span")
    # small row groups, as a span may lie in one file and is read in tasks by row groups
    writer = events.where("ts is not null").select(F.struct(*events.columns).alias("event"), span).write.partitionBy("span")
    writer.option("parquet.block.size", 8 << 20).parquet(sorted_out)
    spans = spark.read.schema(StructType([StructField("event", events.schema), StructField("span", LongType())])).parquet(sorted_out)
    # one number for each span
    numbers = [row["span"] for row in spans.select("span").distinct().orderBy("span").collect()]
    for at in numbers:
        spans.where(F.col("span") == at).select("event.*").repartition(pieces).write.mode("append").parquet(folder)
    if not numbers:
        events.limit(0).write.parquet(folder)
    return events.schema


class Closing:
    """An end mark for an input that has ended: one row, null but for a late enough time.

    It arrives after everything else and moves the watermark past every window
    that is still open, so that windows and sessions come out whole.
    """

    def __init__(self, spark, time):
        self.spark, self.time, self.folder = spark, time, scratch_path(spark, "closing")

    def prepare(self, schema):
        self.schema = schema
        self.spark.createDataFrame([], schema).write.parquet(self.folder)
        return self.folder

    def arrive(self):
        time = F.lit(self.time).cast(self.schema["ts"].dataType)
        columns = [time.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*columns).write.mode("append").parquet(self.folder)


def route_stream(queries):
    """Continuous routing (T1): the batch projection, no state."""
    return route(queries)


def validate_stream(inputs, scenes):
    """Stream-static join with the scene catalogue, then inspection."""
    facts = scenes.select("scene", "path", "band_count", "modality", "crs", "h", "w")
    return inspect(inputs.join(facts, "scene", "left"))


def with_status(routed):
    """Trace rows of arriving requests, refusals included."""
    two = F.col("task").isin("change", "fusion")
    low, n = F.when(two, 2).otherwise(1), F.col("n_inputs")
    return routed.withColumn(
        "status", F.when((n < low) | (n > 2), "validation_failed").otherwise("success")
    ).withColumn("date", F.to_date("ts"))


def trace_sink(requests, build, label):
    """Append-only trace table of arriving requests (T3), read back as a batch frame.

    ``build`` turns the requests of a trigger into trace rows: routed, their
    inputs and pairs checked, refusals and crashes as records of their own.  A
    trigger writes a folder of its own, so one that is repeated replaces itself.
    """
    spark = requests.sparkSession
    target, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def append(rows, number):
        write_traces(build(rows), f"{target}/trigger={number}", mode="overwrite")

    writer = requests.writeStream.foreachBatch(append).option("checkpointLocation", marks)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def counts_per_window(traces, width="1 hour", slide=None):
    """Runs per time window, task and status; late rows are dropped (T4)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return traces.withWatermark("ts", LATE).groupBy(w.alias("w"), "task", "status").agg(
        F.count(F.lit(1)).alias("runs")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "task", "status", "runs")


def sessions(traces, gap="30 minutes"):
    """Sessions of each user (T5)."""
    return traces.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("runs")
    ).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "runs")


def drop_repeats(traces):
    """The first arrival of each run id within the watermark."""
    return traces.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["qid"])


#: A mask as it is kept in state; it has no place of its own, the key tells whether its location is known.
MASK = np.dtype([("location", "<i8"), ("micros", "<i8"), ("fraction", "<f8")])
#: Locations are dealt into so many groups, whose masks are kept and worked on together.
GROUPS = 1024
#: The group of masks without a location.
NOWHERE = -1
#: The time of masks without one.
NO_TIME = np.iinfo(np.int64).min


def masks_of(blobs):
    return np.concatenate([np.empty(0, MASK), *(np.frombuffer(blob, MASK) for (blob,) in blobs)])


class LastMask(StatefulProcessor):
    """Of a group of locations the last mask seen at each, and the arrivals that wait for the watermark."""

    def init(self, handle):
        masks = StructType([StructField("masks", BinaryType())])
        self.handle = handle
        self.last = handle.getValueState("last", masks)
        self.waiting = handle.getListState("waiting", masks)

    def handleInputRows(self, key, rows, timerValues):
        due = None
        for frame in rows:
            masks = np.empty(len(frame), MASK)
            for name in MASK.names:
                masks[name] = frame[name].to_numpy(MASK[name])
            self.waiting.appendList([(masks.tobytes(),)])
            first = int(masks["micros"].min()) // 1000 + 1
            due = first if due is None else min(due, first)
        # at the earliest it expires when the watermark has moved past where it is now
        due = max(1, timerValues.getCurrentWatermarkInMs() + 1, due)
        timer = next(iter(self.handle.listTimers()), None)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        masks = masks_of(self.waiting.get())
        ready = masks["micros"] <= timerValues.getCurrentWatermarkInMs() * 1000
        later, masks = masks[~ready], masks[ready]
        if len(later):
            self.waiting.put([(later.tobytes(),)])
            self.handle.registerTimer(int(later["micros"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        if not len(masks):
            return
        last = masks_of([self.last.get()] if self.last.exists() else [])
        masks, fresh = np.concatenate([last, masks]), np.arange(len(last) + len(masks)) >= len(last)
        order = np.lexsort((masks["fraction"], masks["micros"], fresh, masks["location"]))
        masks, fresh = masks[order], fresh[order]
        begins = np.append(True, masks["location"][1:] != masks["location"][:-1])
        delta = np.where(begins, np.nan, np.diff(masks["fraction"], prepend=np.nan))
        self.last.update((masks[np.append(begins[1:], True)].tobytes(),))
        out = pd.DataFrame({name: masks[name][fresh] for name in MASK.names} | {"delta": delta[fresh]})
        if key[0] == NOWHERE:
            out["location"] = None
        yield out

    def close(self):
        pass


def change_state(masks, late=LATE):
    """Change against the mask before at a location.

    ``masks``: location, ts, fraction.  Arrivals wait in state until the watermark
    has passed them and then come out in order of time, so the order in which
    they arrive within ``late`` does not matter; later ones are dropped by the
    watermark.  Locations are kept in :data:`GROUPS` groups, so that calls go by
    groups and triggers and not by locations.  A task holds what a group sends
    within that time and the last masks of its locations, not a whole trigger.
    Needs the RocksDB state store, which the job sets.
    """
    spark = masks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    group = F.when(F.col("location").isNull(), NOWHERE).otherwise(F.pmod(F.hash("location"), F.lit(GROUPS)))
    grouped = masks.withWatermark("ts", late).withColumn("location", F.col("location").cast("long")).select(
        group.alias("group"), "ts", F.coalesce("location", F.lit(0)).alias("location"),
        F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("micros"), F.col("fraction").cast("double").alias("fraction"),
    ).groupBy("group")
    changes = grouped.transformWithStateInPandas(
        LastMask(), "location long, micros long, fraction double, delta double", "Append", "EventTime",
    )
    ts = F.when(F.col("micros") != NO_TIME, F.timestamp_micros("micros")).alias("ts")
    return changes.select("location", ts, "fraction", "delta")


def run_once(stream, label, partition_by=(), mode="append", closing=None):
    """Process what has arrived into Parquet and return it as a batch frame.

    With ``closing`` the job goes on from its checkpoint after the end mark.
    """
    spark = stream.sparkSession
    target, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    for last in (False, True) if closing else (True,):
        if last and closing:
            closing.arrive()
        writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", marks)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
