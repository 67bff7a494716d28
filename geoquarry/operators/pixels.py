"""Pixel analytics: dB scaling, stretches, composites, indices.

Everything a scene decides (limits, floors, channel choice) is joined to blocks;
pixels are unfolded last and never shuffled one by one.
"""

from pyspark.sql import functions as F

from geoquarry.operators.scale import block_quantiles, finite, join_facts
from geoquarry.sources.blocks import to_pixels

# Fixed values of the two stretches, the dB floor and the indices.
LOW, HIGH = 0.02, 0.98
DB_SHARE, DB_FLOOR = 1e-3, 1e-12
DENOMINATOR = 1e-8
LUMA = (0.299, 0.587, 0.114)
FLAT_DISPLAY, FLAT_ENCODER = 128, 127


def band_stats(blocks, keys=("scene", "band")):
    """Limits, percentiles and least positive value per band."""
    keys = list(keys)
    least = blocks.groupBy(*keys).agg(F.min(F.array_min(_positive("data"))).alias("min_positive"))
    q = block_quantiles(blocks, keys, [LOW, HIGH])
    return least.join(
        q.select(*keys, "n", "vmin", "vmax", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), keys, "left"
    )


def _positive(name):
    return F.filter(name, lambda v: finite(v) & (v > 0))


def _decibel(name, least):
    """Array in dB; the floor lies below the least positive value."""
    floor = F.coalesce(F.greatest(least * DB_SHARE, F.lit(DB_FLOOR)), F.lit(DB_FLOOR))
    return F.transform(name, lambda v: 10.0 * F.log10(F.greatest(F.when(finite(v), v).otherwise(0.0), floor)))


def to_db_blocks(blocks, keys=("scene", "band")):
    """Replace ``data`` by 10*log10 with a floor below the least positive value."""
    keys = list(keys)
    least = blocks.groupBy(*keys).agg(F.min(F.array_min(_positive("data"))).alias("_least"))
    rows = join_facts(blocks, least, keys)
    return rows.withColumn("data", _decibel("data", F.col("_least"))).drop("_least")


def _limited(blocks, keys):
    limits = block_quantiles(blocks, keys, [LOW, HIGH])
    return join_facts(blocks, limits, keys, "left")


def _display(v):
    lo, hi = F.col("q")[0], F.col("q")[1]
    flat = hi <= lo
    low, high = F.when(flat, F.col("vmin")).otherwise(lo), F.when(flat, F.col("vmax")).otherwise(hi)
    scaled = F.when(high <= low, 0.5).otherwise((v - low) / (high - low))
    return F.when(finite(v) & F.col("n").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).otherwise(0.0)


def _workspace(v, lo, hi):
    """Infinite values clip to the ends, missing ones are 0."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))
    usable = lo.isNotNull() & (hi > lo) & v.isNotNull() & ~F.isnan(v)
    return F.when(usable, scaled).otherwise(0.0)


def stretch(blocks, keys=("scene", "band"), flat=FLAT_DISPLAY):
    """2-98 percentile stretch to 0..255, halves to even, flat bands at level ``flat``.

    The display uses 128 (half of 255 rounded to even), the encoder input 127.
    """
    keys = list(keys)
    rows = to_pixels(_limited(blocks, keys), keep=(*keys, "q", "n", "vmin", "vmax"))
    level = F.bround(_display(F.col("v")) * 255).cast("int")
    is_flat = (F.col("vmax") <= F.col("vmin")) & finite(F.col("v"))
    return rows.select(*keys, "y", "x", F.when(is_flat, flat).otherwise(level).alias("u8"))


def stretch_trunc(blocks, keys=("scene", "band")):
    """2-98 percentile stretch, truncated, flat or empty bands 0 (P5)."""
    keys = list(keys)
    rows = to_pixels(_limited(blocks, keys), keep=(*keys, "q"))
    value = _workspace(F.col("v"), F.col("q")[0], F.col("q")[1]) * 255
    return rows.select(*keys, "y", "x", value.cast("int").alias("u8"))


def bands_wide(blocks, bands, names):
    """Chosen bands of a block side by side: one bounded group per block."""
    pick = [F.max(F.when(F.col("band") == b, F.col("data"))).alias(n) for b, n in zip(bands, names)]
    return blocks.where(F.col("band").isin(list(bands))).groupBy("scene", "by", "bx", "h", "w").agg(*pick)


def display_rgb(blocks, scenes):
    """Display composite per scene: (scene, channel, y, x, u8).

    A block's first four bands are laid side by side, so the channels are
    expressions.  SAR bands are dB-scaled before the two-band mean and before
    the stretch.
    """
    names = ("d1", "d2", "d3", "d4")
    wide = bands_wide(blocks, (1, 2, 3, 4), names)
    least = wide.groupBy("scene").agg(*[F.min(F.array_min(_positive(n))).alias(f"least_{n}") for n in names])
    facts = scenes.select("scene", "band_count", F.coalesce("is_sar", F.lit(False)).alias("is_sar")).join(least, "scene")
    rows = join_facts(wide, facts, ["scene"])
    rows = rows.withColumns({
        n: F.when(F.col("is_sar"), _decibel(n, F.col(f"least_{n}"))).otherwise(F.col(n)) for n in names})
    d1, d2, d3, d4 = (F.col(n) for n in names)
    mean = F.zip_with("d1", "d2", lambda p, q: (p + q) / 2.0)
    n, sar = F.col("band_count"), F.col("is_sar")
    channels = (
        F.when(n == 1, F.array(d1, d1, d1))
        .when(n == 2, F.array(d1, d2, mean))
        .when((n == 4) & ~sar, F.array(d3, d2, d1))
        .when(n.isin(12, 13), F.array(d4, d3, d2))
        .otherwise(F.array(d1, d2, d3))
    )
    shown = rows.select("scene", "by", "bx", "h", "w", F.posexplode(channels).alias("channel", "data"))
    return stretch(shown, ("scene", "channel"))


def natural_colour(blocks, red=3, green=2, blue=1):
    """Three chosen bands stretched with :func:`stretch_trunc` rules."""
    bands, names = (red, green, blue), ("r", "g", "b")
    chosen = blocks.where(F.col("band").isin(list(bands)))
    limits = block_quantiles(chosen, ["scene", "band"], [LOW, HIGH])
    wide = limits.groupBy("scene").agg(*[
        F.max(F.when(F.col("band") == b, F.col("q"))).alias(f"q_{n}") for b, n in zip(bands, names)
    ])
    rows = join_facts(bands_wide(blocks, bands, names), wide, ["scene"], "left")
    px = to_pixels(rows, names, names, keep=("scene", "q_r", "q_g", "q_b"))
    level = lambda n: (_workspace(F.col(n), F.col(f"q_{n}")[0], F.col(f"q_{n}")[1]) * 255).cast("int").alias(n)
    return px.select("scene", "y", "x", *[level(n) for n in names])


def normalised_difference(a, b):
    """(a-b)/(a+b) in [-1, 1], null where the sum vanishes or a value is missing."""
    total = a + b
    value = F.when(finite(total) & (F.abs(total) > DENOMINATOR), (a - b) / total)
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def nd_index(blocks, first, second):
    """Normalised difference of two bands per pixel."""
    px = to_pixels(bands_wide(blocks, (first, second), ("a", "b")), ("a", "b"), ("a", "b"), keep=("scene",))
    value = normalised_difference(F.col("a"), F.col("b"))
    missing = F.col("a").isNull() | F.col("b").isNull()
    return px.select("scene", "y", "x", F.when(~missing, value).alias("value"))


def index_class(index, kind="ndvi"):
    """Display class of an index value, missing counted as 0."""
    v = F.coalesce("value", F.lit(0.0))
    if kind == "ndvi":
        group = F.when(v < 0, 0).when(v < 0.2, 1).when(v < 0.5, 2).otherwise(3)
    else:
        group = F.when(v <= 0, 0).when(v < 0.3, 1).otherwise(2)
    return index.select("*", group.alias("class"))


def index_stats(index):
    """Minimum, mean and maximum of the defined pixels per scene (A2)."""
    return index.groupBy("scene").agg(
        F.min("value").alias("minimum"), F.avg("value").alias("mean"), F.max("value").alias("maximum")
    )


def luma(r, g, b):
    """Rounded grey level of an RGB pixel (P10)."""
    return F.round(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b).cast("int")


def mean_grey(*channels):
    """Mean of channels, the grey of the agreement map (P10)."""
    total = channels[0]
    for c in channels[1:]:
        total = total + c
    return total / float(len(channels))
