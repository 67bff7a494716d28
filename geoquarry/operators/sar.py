"""Radar backscatter statistics per scene (A3)."""

from pyspark.sql import functions as F

from geoquarry.operators.scale import block_quantiles, finite
from geoquarry.sources.blocks import to_pixels

# Backscatter limits in dB and decision shares.
WATER_BELOW, BUILT_ABOVE, SMOOTH_LOW, SMOOTH_HIGH = -20.0, -5.0, -15.0, -8.0
WATER_SHARE, BUILT_SHARE, BOUNCE_SHARE, BUILT_ALONE = 0.1, 0.05, 0.1, 0.1
RATIO_FLOOR, RATIO_HIGH = 1e-12, 0.5


def sar_physics(blocks, units="db"):
    """Statistics and flags from ``vv`` and, where given, ``vh`` (A3).

    ``units='linear'`` converts VV to dB before the limits are applied.  Ratio
    statistics pair VV and VH of the same pixel, both finite.
    """
    polarised = "vh" in blocks.columns
    names = ("vv", "vh") if polarised else ("vv",)
    if units == "linear":
        decibel = lambda v: F.when(finite(v) & (v > 0), 10.0 * F.log10(v))
        blocks = blocks.withColumns({n: F.transform(n, decibel) for n in names})
    vv = F.col("vv")
    px = to_pixels(blocks, names, names, keep=("scene",))
    ok = finite(vv)
    share = lambda cond: F.avg(F.when(ok, F.when(cond, 1.0).otherwise(0.0)))
    outputs = [
        F.count(F.when(ok, 1)).alias("n"),
        F.avg(F.when(ok, vv)).alias("vv_mean"),
        share(vv < WATER_BELOW).alias("water_fraction"),
        share(vv > BUILT_ABOVE).alias("built_fraction"),
        share((vv > SMOOTH_LOW) & (vv < SMOOTH_HIGH)).alias("smooth_fraction"),
    ]
    if polarised:
        both = ok & finite(F.col("vh"))
        ratio = F.col("vh") / F.greatest(vv, F.lit(RATIO_FLOOR))
        outputs += [
            F.avg(F.when(both, ratio)).alias("ratio_mean"),
            F.avg(F.when(both, F.when(ratio > RATIO_HIGH, 1.0).otherwise(0.0))).alias("bounce_fraction"),
        ]
    sums = px.groupBy("scene").agg(*outputs)
    q = block_quantiles(blocks, ["scene"], [0.5, 0.1, 0.9], data="vv").select(
        "scene", *[F.col("q")[i].alias(n) for i, n in enumerate(("vv_median", "vv_p10", "vv_p90"))]
    )
    rows = sums.join(q, "scene", "left")
    built = F.col("built_fraction")
    if polarised:
        possible = F.when(
            F.col("bounce_fraction").isNotNull(), (built > BUILT_SHARE) & (F.col("bounce_fraction") > BOUNCE_SHARE)
        ).otherwise(built > BUILT_ALONE)
        zero = [n for n in ("ratio_mean", "bounce_fraction")]
        filled = {n: F.when(F.col("n") > 0, F.coalesce(n, F.lit(0.0))) for n in zero}
    else:
        possible, filled = built > BUILT_ALONE, {}
    return rows.withColumn("potential_water", F.col("water_fraction") > WATER_SHARE).withColumn(
        "built_up_possible", possible
    ).withColumns(
        {**filled, "error": F.when(F.col("n") == 0, "no finite VV values")}
    )
