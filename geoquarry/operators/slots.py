"""The 14-slot stack: stacking, mapping, filling, standardising."""

from pyspark.sql import functions as F

from geoquarry.operators.scale import finite, join_facts

# Slot order, resolutions, default statistics, fill strategy.
SLOTS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B09", "B11", "B12", "B8A", "VV", "VH"]
RADAR = ["VV", "VH"]
RESOLUTION = {"B02": 10, "B03": 10, "B04": 10, "B08": 10, "B01": 60, "B09": 60}
DEFAULT_MEAN, DEFAULT_STD = 900.0, 900.0
RADAR_MEAN, RADAR_STD = 0.08, 0.04
FILL_STRATEGY = "per_channel_training_mean"
SPREAD = 3.0


def _strings(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def slot_status(slot_blocks):
    """Slots present and absent per scene; a scene without all 14 is an error."""
    found = slot_blocks.groupBy("scene").agg(F.collect_set("slot").alias("_found"))
    absent = F.array_except(_strings(SLOTS), F.col("_found"))
    return found.select(
        "scene",
        F.size("_found").alias("filled"),
        absent.alias("slots_absent"),
        F.when(F.size(absent) > 0, F.concat(F.lit("missing band(s): "), F.array_join(absent, ","))).alias("error"),
    )


def stack_patch(slot_blocks):
    """Blocks of complete scenes with their slot number, and the error rows."""
    status = slot_status(slot_blocks)
    good = status.where("error is null").select("scene")
    order = F.array_position(_strings(SLOTS), F.col("slot")).cast("int") - 1
    stacked = join_facts(slot_blocks.drop("slot_ordinal"), good, ["scene"])
    return stacked.withColumn("slot_ordinal", order), status.where("error is not null")


def map_slots(scenes):
    """Slot assignment of each scene by modality and band count."""
    n, modality = F.col("band_count"), F.coalesce("modality", F.lit("unknown"))

    def assign(*pairs):
        return F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(b).alias("band")) for s, b in pairs])

    none = F.array().cast("array<struct<slot:string,band:int>>")
    colour = assign(("B02", 1), ("B03", 2), ("B04", 3), ("B08", 4))
    chosen = (
        F.when(n == 14, assign(*[(s, i + 1) for i, s in enumerate(SLOTS)]))
        .when((modality == "sar") & (n >= 2), assign(("VV", 1), ("VH", 2)))
        .when((modality == "sar") & (n == 1), assign(("VV", 1)))
        .when(n == 3, assign(("B04", 1), ("B03", 2), ("B02", 3)))
        .when(n == 1, assign(("B04", 1), ("B03", 1), ("B02", 1)))
        .when(n == 2, assign(("VV", 1), ("VH", 2)))
        .when(n >= 4, colour)
        .otherwise(none)
    )
    by_count = F.when(n == 3, "optical").when(n.isin(4, 12, 13, 14), "msi").otherwise("unknown")
    source = (
        F.when((n == 14) & (modality != "unknown"), modality)
        .when(n == 14, "msi")
        .when(modality == "sar", "sar")
        .otherwise(by_count)
    )
    filled = F.transform(chosen, lambda c: c["slot"])
    return scenes.select(
        "scene",
        chosen.alias("assignment"),
        F.array_sort(filled).alias("slots_filled"),
        F.array_sort(F.array_except(_strings(SLOTS), filled)).alias("slots_absent"),
        F.lit(FILL_STRATEGY).alias("fill_strategy"),
        source.alias("source_modality"),
    )


def to_slots(blocks, mapping):
    """Band blocks renamed to the slots their scene assigns."""
    rules = mapping.select("scene", F.explode("assignment").alias("a")).select("scene", "a.band", "a.slot")
    return join_facts(blocks, rules, ["scene", "band"]).drop("band")


def channel_stats(slot_blocks):
    """Mean and population deviation per slot over finite values (A1)."""
    values = slot_blocks.select("slot", F.explode("data").alias("v")).where(finite(F.col("v")))
    sums = values.groupBy("slot").agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")
    )
    every = slot_blocks.sparkSession.range(1).select(F.explode(_strings(SLOTS)).alias("slot"))
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    radar = F.col("slot").isin(RADAR)
    return every.join(sums, "slot", "left").select(
        "slot",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(mean, F.when(radar, RADAR_MEAN).otherwise(DEFAULT_MEAN)).alias("mean"),
        F.coalesce(deviation, F.when(radar, RADAR_STD).otherwise(DEFAULT_STD)).alias("std"),
    )


def _fourteen(stats):
    """At most one row per slot name, so the broadcast is bounded by the slot list."""
    kept = stats.where(F.col("slot").isin(SLOTS)).groupBy("slot").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    return F.broadcast(kept)


def fill_absent(slot_blocks, stats):
    """All 14 slots per block position; absent ones hold the training mean."""
    places = slot_blocks.select("scene", "by", "bx", "h", "w").distinct()
    wanted = places.select("*", F.explode(_strings(SLOTS)).alias("slot")).join(_fourteen(stats), "slot", "left")
    have = slot_blocks.select("scene", "by", "bx", "slot", "data")
    mean = F.coalesce("mean", F.lit(0.0))
    return wanted.join(have, ["scene", "by", "bx", "slot"], "left").select(
        "scene", "slot", "by", "bx", "h", "w",
        F.coalesce("data", F.array_repeat(mean, F.col("h") * F.col("w"))).alias("data"),
        F.col("data").isNull().alias("absent"),
    )


def standardise(slot_blocks, stats):
    """(v-mean)/std over three, clamped to [-1, 1]; a zero deviation counts as 1."""
    rows = slot_blocks.join(_fourteen(stats), "slot", "left")
    mean = F.coalesce("mean", F.lit(0.0))
    std = F.when(F.coalesce("std", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("std", F.lit(1.0)))
    scaled = F.transform(
        "data",
        lambda v: F.when(F.isnan(v), v).otherwise(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (v - mean) / std / SPREAD))
        ),
    )
    return rows.withColumn("data", scaled).drop("mean", "std")
