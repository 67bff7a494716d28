"""Pixel, radar and slot queries."""

from pyspark.sql import functions as F

from geoquarry.operators import grid, pixels, sar, slots
from geoquarry.operators.scale import block_quantiles
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import EXTRA as SCENE_VIEWS, guarded, six
from geoquarry.plans.sql import sql_list
from geoquarry.sources import blocks as B
from geoquarry.session import scratch_path

EXTRA = {
    **SCENE_VIEWS,
    "v_lim": """
        SELECT scene, band, count(*) AS n, min(v) AS vmin, max(v) AS vmax, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi
        FROM v_px WHERE isfinite(v) GROUP BY ALL""",
    "v_trunc": """
        SELECT p.scene, p.band, p.y, p.x,
          CASE WHEN lo IS NULL OR hi <= lo OR isnan(v) THEN 0 ELSE trunc(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 255) END::INT AS u8
        FROM v_px p LEFT JOIN v_lim USING (scene, band)""",
    "v_nd": """
        SELECT a.scene, a.y, a.x, CASE WHEN isfinite(a.v) AND isfinite(b.v) AND abs(a.v + b.v) > 1e-8
               THEN greatest(-1.0, least(1.0, (a.v - b.v) / (a.v + b.v))) END AS value
        FROM v_px a JOIN v_px b USING (scene, y, x) WHERE a.band = 4 AND b.band = 3""",
    "v_stat": """
        SELECT slot, count(*) AS n, avg(v) AS mean, sqrt(greatest(sum(v * v) / count(*) - avg(v) * avg(v), 0)) AS std
        FROM v_slot WHERE isfinite(v) GROUP BY slot""",
    "v_channel": """
        SELECT scene, is_sar, unnest(range(0, 3))::INT AS channel,
               unnest(CASE WHEN band_count = 1 THEN [1, 1, 1] WHEN band_count = 2 THEN [1, 2, 1]
                    WHEN band_count = 4 AND NOT is_sar THEN [3, 2, 1] WHEN band_count IN (12, 13) THEN [4, 3, 2] ELSE [1, 2, 3] END) AS b0,
               unnest(CASE WHEN band_count = 2 THEN [NULL, NULL, 2] ELSE [NULL, NULL, NULL] END) AS b1
        FROM v_guard""",
    "v_pxdb": """
        SELECT scene, band, y, x, CASE WHEN is_sar THEN 10 * log10(greatest(CASE WHEN isfinite(v) THEN v ELSE 0 END, flo)) ELSE v END AS v
        FROM v_px JOIN v_guard USING (scene)
        JOIN (SELECT scene, band, coalesce(greatest(min(v) FILTER (isfinite(v) AND v > 0) * 1e-3, 1e-12), 1e-12) AS flo
              FROM v_px GROUP BY ALL) USING (scene, band)""",
    "v_disp": """
        SELECT c.scene, c.channel, p.y, p.x, CASE WHEN b1 IS NULL THEN p.v ELSE (p.v + q.v) / 2 END AS v
        FROM v_channel c JOIN v_pxdb p ON p.scene = c.scene AND p.band = c.b0
        LEFT JOIN v_pxdb q ON q.scene = c.scene AND q.band = c.b1 AND q.y = p.y AND q.x = p.x""",
}


@query("s1_block_scan", """
    SELECT scene, band, 'Band_' || band AS name, 4 AS blocks, count(*) AS pixels FROM v_px GROUP BY scene, band""")
def s1(spark, sf):
    path = scratch_path(spark, "blocks")
    V.band_blocks(spark, sf).write.parquet(path)
    rows = B.read_blocks(spark, path)
    sizes = rows.groupBy("scene", "band").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.col("h") * F.col("w")).alias("pixels"))
    return B.band_names(rows).join(sizes, ["scene", "band"])


@query("s2_to_pixels", "SELECT scene, band, y, x, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) + 0.0 END AS v FROM v_px")
def s2(spark, sf):
    px = V.band_pixels(spark, sf)
    return px.withColumn("v", F.when(~F.isnan("v"), F.round("v", 6) + 0.0))


@query("s3_select_band", """
    SELECT scene, NULL::VARCHAR AS error, count(*) AS pixels FROM v_px WHERE band = 4 GROUP BY scene UNION ALL
    SELECT scene, 'Selected band 4 does not exist. This file contains ' || band_count || ' band(s).', NULL FROM v_scene WHERE band_count < 4""")
def s3(spark, sf):
    px, errors = B.select_band(V.band_pixels(spark, sf), V.scenes(spark, sf), 4)
    good = px.groupBy("scene").agg(F.count(F.lit(1)).alias("pixels")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors.withColumn("pixels", F.lit(None).cast("long")))


@query("s13_write_blocks", """
    SELECT scene, count(*) AS pixels, round(sum(coalesce(value, 0.0)::FLOAT::DOUBLE), 5) AS total FROM v_nd GROUP BY scene""", EXTRA)
def s13(spark, sf):
    index = pixels.nd_index(V.band_blocks(spark, sf), 4, 3).withColumn("v", F.coalesce("value", F.lit(0.0)))
    path = scratch_path(spark, "index")
    B.write_blocks(B.to_blocks(index, 4, ("scene",)), path)
    back = B.to_pixels(B.read_blocks(spark, path), keep=("scene",))
    return back.groupBy("scene").agg(
        F.count(F.lit(1)).alias("pixels"), (F.round(F.sum(F.col("v").cast("double")), 5) + 0.0).alias("total"))


@query("p3_to_db", """
    SELECT scene, y, x, round(10 * log10(greatest(CASE WHEN isfinite(vv) THEN vv ELSE 0 END, flo)), 6) + 0.0 AS v
    FROM v_lin JOIN (SELECT scene, coalesce(greatest(min(vv) FILTER (isfinite(vv) AND vv > 0) * 1e-3, 1e-12), 1e-12) AS flo FROM v_lin GROUP BY scene) USING (scene)""")
def p3(spark, sf):
    blocks = V.sar_blocks(spark, sf, "linear").withColumn("data", F.col("vv"))
    px = B.to_pixels(pixels.to_db_blocks(blocks, ("scene",)), keep=("scene",))
    return px.withColumn("v", F.round("v", 6) + 0.0)


@query("p4_stretch", """
    SELECT scene, band, y, x, round_even(CASE WHEN NOT isfinite(v) OR n IS NULL THEN 0.0 WHEN h2 <= l2 THEN 0.5
           ELSE greatest(0.0, least(1.0, (v - l2) / (h2 - l2))) END * 255, 0)::INT AS u8
    FROM (SELECT p.*, n, CASE WHEN hi <= lo THEN vmin ELSE lo END AS l2, CASE WHEN hi <= lo THEN vmax ELSE hi END AS h2
          FROM v_px p LEFT JOIN v_lim USING (scene, band))""", EXTRA)
def p4(spark, sf):
    return pixels.stretch(V.band_blocks(spark, sf))


@query("p4_stretch_encoder", """
    SELECT scene, band, y, x, CASE WHEN vmax <= vmin AND isfinite(v) THEN 127 ELSE round_even(CASE WHEN NOT isfinite(v) THEN 0.0
           ELSE greatest(0.0, least(1.0, (v - lo) / (hi - lo))) END * 255, 0)::INT END AS u8 FROM v_px LEFT JOIN v_lim USING (scene, band)""", EXTRA)
def p4_encoder(spark, sf):
    return pixels.stretch(V.band_blocks(spark, sf), flat=pixels.FLAT_ENCODER)


@query("p5_stretch_trunc", "SELECT * FROM v_trunc", EXTRA)
def p5(spark, sf):
    return pixels.stretch_trunc(V.band_blocks(spark, sf))


@query("p6_display_rgb", """
    SELECT scene, channel, y, x, round_even(CASE WHEN NOT isfinite(v) OR n IS NULL THEN 0.0 WHEN h2 <= l2 THEN 0.5
           ELSE greatest(0.0, least(1.0, (v - l2) / (h2 - l2))) END * 255, 0)::INT AS u8
    FROM (SELECT p.*, n, CASE WHEN hi <= lo THEN vmin ELSE lo END AS l2, CASE WHEN hi <= lo THEN vmax ELSE hi END AS h2
          FROM v_disp p LEFT JOIN (
            SELECT scene, channel, count(*) AS n, min(v) AS vmin, max(v) AS vmax, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi
            FROM v_disp WHERE isfinite(v) GROUP BY ALL) USING (scene, channel))""", EXTRA)
def p6(spark, sf):
    return pixels.display_rgb(V.band_blocks(spark, sf), guarded(spark, sf))


@query("p7_natural_colour", """
    SELECT scene, y, x, max(u8) FILTER (band = 3) AS r, max(u8) FILTER (band = 2) AS g, max(u8) FILTER (band = 1) AS b
    FROM v_trunc GROUP BY scene, y, x""", EXTRA)
def p7(spark, sf):
    return pixels.natural_colour(V.band_blocks(spark, sf), 3, 2, 1)


@query("p8_nd_index", "SELECT scene, y, x, round(value, 6) + 0.0 AS value FROM v_nd", EXTRA)
def p8(spark, sf):
    return pixels.nd_index(V.band_blocks(spark, sf), 4, 3).withColumn("value", F.round("value", 6) + 0.0)


@query("p9_index_class", """
    SELECT scene, y, x, CASE WHEN coalesce(value, 0) < 0 THEN 0 WHEN coalesce(value, 0) < 0.2 THEN 1 WHEN coalesce(value, 0) < 0.5 THEN 2 ELSE 3 END AS ndvi_class,
           CASE WHEN coalesce(value, 0) <= 0 THEN 0 WHEN coalesce(value, 0) < 0.3 THEN 1 ELSE 2 END AS ndwi_class FROM v_nd""", EXTRA)
def p9(spark, sf):
    index = pixels.nd_index(V.band_blocks(spark, sf), 4, 3)
    both = pixels.index_class(pixels.index_class(index).withColumnRenamed("class", "ndvi_class"), "ndwi")
    return both.select("scene", "y", "x", "ndvi_class", F.col("class").alias("ndwi_class"))


@query("p10_to_gray", """
    SELECT scene, y, x, floor(0.299::DOUBLE * g0 + 0.587::DOUBLE * g1 + 0.114::DOUBLE * (l0 * 40) + 0.5)::INT AS luma,
           round((g0 + g1 + l0 * 40) / 3.0::DOUBLE, 6) AS mean_grey FROM v_pair""")
def p10(spark, sf):
    names = ("g0", "g1", "l0")
    px = B.to_pixels(V.pair_blocks(spark, sf), names, names, keep=("scene",))
    r, g, b = F.col("g0"), F.col("g1"), F.col("l0") * 40
    return px.select("scene", "y", "x", pixels.luma(r, g, b).alias("luma"), F.round(pixels.mean_grey(r, g, b), 6).alias("mean_grey"))


@query("a2_index_stats", """
    SELECT scene, round(min(value), 6) + 0.0 AS minimum, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS maximum
    FROM v_nd GROUP BY scene""", EXTRA)
def a2(spark, sf):
    rows = pixels.index_stats(pixels.nd_index(V.band_blocks(spark, sf), 4, 3))
    return rows.select("scene", six("minimum"), six("mean"), six("maximum"))


@query("a23_band_stats", """
    SELECT scene, band, n, round(vmin, 6) + 0.0 AS vmin, round(vmax, 6) + 0.0 AS vmax, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi,
           round(mp, 6) + 0.0 AS min_positive
    FROM v_lim JOIN (SELECT scene, band, min(v) FILTER (isfinite(v) AND v > 0) AS mp FROM v_px GROUP BY ALL) USING (scene, band)""", EXTRA)
def a23(spark, sf):
    rows = pixels.band_stats(V.band_blocks(spark, sf))
    return rows.select("scene", "band", "n", *[six(c) for c in ("vmin", "vmax", "lo", "hi", "min_positive")])


@query("a23_quantiles_of_large_groups", """
    SELECT band, count(*) AS n, round(quantile_cont(v, 0.02), 6) + 0.0 AS lo, round(quantile_cont(v, 0.5), 6) + 0.0 AS mid,
           round(quantile_cont(v, 0.98), 6) + 0.0 AS hi FROM v_px WHERE isfinite(v) GROUP BY band""")
def a23_large(spark, sf):
    rows = block_quantiles(V.band_blocks(spark, sf), ["band"], [0.02, 0.5, 0.98], big=0)
    level = lambda i, n: (F.round(F.col("q")[i], 6) + 0.0).alias(n)
    return rows.select("band", "n", level(0, "lo"), level(1, "mid"), level(2, "hi"))


_SAR = """
    SELECT scene, n, round(m, 5) + 0.0 AS vv_mean, round(w, 6) + 0.0 AS water_fraction, round(b, 6) + 0.0 AS built_fraction,
           round(s, 6) + 0.0 AS smooth_fraction, CASE WHEN abs(rm) < 1e6 THEN round(rm, 4) + 0.0 ELSE round(rm / 1e12, 4) + 0.0 END AS ratio_mean,
           round(bf, 6) + 0.0 AS bounce_fraction, round(med, 5) + 0.0 AS vv_median, round(p10, 5) + 0.0 AS vv_p10, round(p90, 5) + 0.0 AS vv_p90,
           w > 0.1 AS potential_water, b > 0.05 AND bf > 0.1 AS built_up_possible
    FROM (SELECT scene, count(*) AS n, avg(vv) AS m, avg(CASE WHEN vv < -20 THEN 1.0 ELSE 0 END) AS w, avg(CASE WHEN vv > -5 THEN 1.0 ELSE 0 END) AS b,
            avg(CASE WHEN vv > -15 AND vv < -8 THEN 1.0 ELSE 0 END) AS s, avg(CASE WHEN isfinite(vh) THEN vh / greatest(vv, 1e-12) END) AS rm,
            avg(CASE WHEN isfinite(vh) THEN CASE WHEN vh / greatest(vv, 1e-12) > 0.5 THEN 1.0 ELSE 0 END END) AS bf,
            quantile_cont(vv, 0.5) AS med, quantile_cont(vv, 0.1) AS p10, quantile_cont(vv, 0.9) AS p90
          FROM v_sar WHERE isfinite(vv) GROUP BY scene)"""


def _sar_columns(rows):
    r = F.col("ratio_mean")
    ratio = F.when(F.abs(r) < 1e6, F.round(r, 4)).otherwise(F.round(r / 1e12, 4)) + 0.0
    return rows.select(
        "scene", "n", *[six(c) for c in ("water_fraction", "built_fraction", "smooth_fraction", "bounce_fraction")],
        *[(F.round(c, 5) + 0.0).alias(c) for c in ("vv_mean", "vv_median", "vv_p10", "vv_p90")],
        ratio.alias("ratio_mean"), "potential_water", "built_up_possible")


@query("a3_sar_physics", _SAR)
def a3(spark, sf):
    return _sar_columns(sar.sar_physics(V.sar_blocks(spark, sf)))


@query("a3_sar_physics_linear", _SAR.replace(
    "v_sar", "(SELECT scene, y, x, CASE WHEN isfinite(vv) AND vv > 0 THEN 10 * log10(vv) END AS vv, CASE WHEN isfinite(vh) AND vh > 0 THEN 10 * log10(vh) END AS vh FROM v_lin)"))
def a3_linear(spark, sf):
    return _sar_columns(sar.sar_physics(V.sar_blocks(spark, sf, "linear"), units="linear"))


@query("s16_stack_patch", f"""
    SELECT scene, count(DISTINCT slot)::INT AS filled, count(*) AS pixels,
           CASE WHEN count(DISTINCT slot) < 14 THEN 'missing band(s): ' || array_to_string(list_filter({sql_list(slots.SLOTS)}, lambda s: NOT list_contains(list(DISTINCT slot), s)), ',') END AS error
    FROM v_slot GROUP BY scene""")
def s16(spark, sf):
    blocks = V.slot_blocks(spark, sf)
    stacked, errors = slots.stack_patch(blocks)
    good = stacked.groupBy("scene").agg(
        F.countDistinct("slot").cast("int").alias("filled"), F.sum(F.size("data")).alias("pixels"),
        F.lit(None).cast("string").alias("error"))
    found = blocks.groupBy("scene").agg(F.sum(F.size("data")).alias("pixels"))
    return good.unionByName(errors.select("scene", "filled", "error").join(found, "scene"), allowMissingColumns=True)


@query("u3_absent_slots", f"""
    SELECT scene, array_to_string(list_filter({sql_list(slots.SLOTS)}, lambda s: NOT list_contains(list(DISTINCT slot), s)), ',') AS absent
    FROM v_slot GROUP BY scene""")
def u3(spark, sf):
    return slots.slot_status(V.slot_blocks(spark, sf)).select("scene", F.array_join("slots_absent", ",").alias("absent"))


@query("p11_map_slots", f"""
    SELECT scene, array_to_string(list_sort(filled), ',') AS slots_filled,
           array_to_string(list_sort(list_filter({sql_list(slots.SLOTS)}, lambda s: NOT list_contains(filled, s))), ',') AS slots_absent,
           'per_channel_training_mean' AS fill_strategy,
           CASE WHEN modality = 'sar' THEN 'sar' WHEN band_count = 3 THEN 'optical' WHEN band_count IN (4, 12, 13) THEN 'msi' ELSE 'unknown' END AS source_modality
    FROM (SELECT *, CASE WHEN modality = 'sar' AND band_count >= 2 THEN ['VV', 'VH'] WHEN modality = 'sar' THEN ['VV']
               WHEN band_count IN (1, 3) THEN ['B04', 'B03', 'B02'] WHEN band_count = 2 THEN ['VV', 'VH'] ELSE ['B02', 'B03', 'B04', 'B08'] END AS filled
          FROM v_guard)""", EXTRA)
def p11(spark, sf):
    rows = slots.map_slots(guarded(spark, sf))
    return rows.select("scene", F.array_join("slots_filled", ",").alias("slots_filled"),
                       F.array_join("slots_absent", ",").alias("slots_absent"), "fill_strategy", "source_modality")


@query("a1_channel_stats", f"""
    SELECT slot, coalesce(n, 0) AS n, round(coalesce(mean, 900), 6) + 0.0 AS mean, round(coalesce(std, 900), 6) + 0.0 AS std
    FROM (SELECT unnest({sql_list(slots.SLOTS)}) AS slot) LEFT JOIN v_stat USING (slot)""", EXTRA)
def a1(spark, sf):
    return slots.channel_stats(V.slot_blocks(spark, sf)).select("slot", "n", six("mean"), six("std"))


@query("p12_fill_absent", f"""
    SELECT scene, slot, have.n IS NULL AS absent, round(coalesce(have.total, 64 * mean), 5) + 0.0 AS total
    FROM (SELECT scene, slot FROM (SELECT DISTINCT scene FROM v_slot), (SELECT unnest({sql_list(slots.SLOTS)}) AS slot))
    LEFT JOIN (SELECT scene, slot, count(*) AS n, sum(v) AS total FROM v_slot GROUP BY ALL) have USING (scene, slot) LEFT JOIN v_stat USING (slot)""", EXTRA)
def p12(spark, sf):
    blocks = V.slot_blocks(spark, sf)
    filled = slots.fill_absent(blocks, slots.channel_stats(blocks))
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v)
    return filled.select("scene", "slot", "absent", (F.round(total, 5) + 0.0).alias("total"))


@query("p13_standardise", """
    SELECT scene, slot, y, x, round(greatest(-1.0, least(1.0, (v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END / 3)), 6) + 0.0 AS v
    FROM v_slot JOIN v_stat USING (slot)""", EXTRA)
def p13(spark, sf):
    blocks = V.slot_blocks(spark, sf)
    rows = slots.standardise(blocks, slots.channel_stats(blocks))
    return B.to_pixels(rows, keep=("scene", "slot")).withColumn("v", F.round("v", 6) + 0.0)


@query("j9_align_px", "SELECT scene, count(*) AS pixels, sum((g0 - g1)::BIGINT) AS difference, sum((g0 > g1)::INT) AS darker, 0 AS errors FROM v_pair GROUP BY scene", types={"difference": "BIGINT", "darker": "BIGINT"})
def j9(spark, sf):
    pair = V.pair_blocks(spark, sf)
    px, errors = grid.align_px(pair.withColumn("data", F.col("g0")), pair.withColumn("data", F.col("g1")))
    rows = px.groupBy("scene").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(F.col("a") - F.col("b")).alias("difference"),
        F.sum((F.col("a") > F.col("b")).cast("int")).alias("darker"))
    bad = errors.groupBy("scene").agg(F.count(F.lit(1)).cast("int").alias("errors"))
    return rows.join(bad, "scene", "left").na.fill(0, ["errors"])


def _bilinear(inner, nulls=""):
    """Four-neighbour weighting in SQL over positions (sy, sx) on an 8x8 grid."""
    return f"""
        SELECT t.scene, t.band, t.y, t.x, {nulls} CASE WHEN isnan(r) THEN NULL ELSE round(r, 5) + 0.0 END {'END' if nulls else ''} AS v
        FROM (SELECT q.*, a.v * (1 - fy) * (1 - fx) + b.v * (1 - fy) * fx + c.v * fy * (1 - fx) + d.v * fy * fx AS r
          FROM (SELECT *, floor(cy)::INT AS y0, floor(cx)::INT AS x0, least(floor(cy)::INT + 1, 7) AS y1, least(floor(cx)::INT + 1, 7) AS x1,
                       cy - floor(cy) AS fy, cx - floor(cx) AS fx
                FROM (SELECT *, greatest(0.0, least(7.0, sy)) AS cy, greatest(0.0, least(7.0, sx)) AS cx FROM ({inner}))) q
          JOIN v_px a ON a.scene = q.scene AND a.band = q.band AND a.y = q.y0 AND a.x = q.x0
          JOIN v_px b ON b.scene = q.scene AND b.band = q.band AND b.y = q.y0 AND b.x = q.x1
          JOIN v_px c ON c.scene = q.scene AND c.band = q.band AND c.y = q.y1 AND c.x = q.x0
          JOIN v_px d ON d.scene = q.scene AND d.band = q.band AND d.y = q.y1 AND d.x = q.x1) t"""


@query("j11_resample_bilinear", _bilinear("""
    SELECT scene, band, y, x, y * (8 / 12.0::DOUBLE) + (0.5 * (8 / 12.0::DOUBLE) - 0.5) AS sy, x * (8 / 12.0::DOUBLE) + (0.5 * (8 / 12.0::DOUBLE) - 0.5) AS sx
    FROM (SELECT DISTINCT scene, band FROM v_px), (SELECT unnest(range(0, 12))::INT AS y), (SELECT unnest(range(0, 12))::INT AS x)"""))
def j11(spark, sf):
    out = grid.resample_bilinear(V.band_blocks(spark, sf), 12, 12, size=V.BLOCK)
    return B.to_pixels(out).withColumn("v", F.when(~F.isnan("v"), F.round("v", 5) + 0.0))


@query("j10_align_to_grid", """
    SELECT scene, band, y, x, v, NULL::VARCHAR AS error FROM (""" + _bilinear("""
      SELECT s.scene, band, y, x, (-ta / -ta) * y + ((0.5 * -ta + (tf - ta * 1.5::DOUBLE) - tf) / -ta - 0.5) AS sy, (ta / ta) * x + ((0.5 * ta + (tc + ta * 0.25::DOUBLE) - tc) / ta - 0.5) AS sx
      FROM v_scene s, (SELECT unnest([1, 2, 3, 4])::INT AS band), (SELECT unnest(range(0, 8))::INT AS y), (SELECT unnest(range(0, 8))::INT AS x)
      WHERE crs IS NOT NULL AND s.scene % 10 <> 7""", "CASE WHEN sy > 7.5 OR sx > 7.5 THEN NULL ELSE") + """)
    UNION ALL SELECT scene, band, NULL, NULL, NULL, CASE WHEN crs IS NULL THEN 'Automatic spatial alignment requires georeferencing.' ELSE 'Grid is rotated.' END
    FROM v_scene, (SELECT unnest([1, 2, 3, 4])::INT AS band) WHERE crs IS NULL OR scene % 10 = 7""")
def j10(spark, sf):
    t = F.col("transform")
    grids = V.scenes(spark, sf).select(
        "scene", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 4)])).alias("band"),
        t.alias("src_transform"), F.col("crs").alias("src_crs"), F.col("crs").alias("dst_crs"),
        F.array(t[0], F.when(F.col("scene") % 10 == 7, 0.5).otherwise(t[1]), t[2] + t[0] * 0.25, t[3], t[4], t[5] + t[4] * 1.5).alias("dst_transform"),
        F.lit(8).alias("out_h"), F.lit(8).alias("out_w"))
    out, errors = grid.align_to_grid(V.band_blocks(spark, sf), grids, size=V.BLOCK)
    px = B.to_pixels(out).withColumns({
        "v": F.when(~F.isnan("v"), F.round("v", 5) + 0.0), "error": F.lit(None).cast("string")})
    return px.unionByName(errors, allowMissingColumns=True)


@query("j12_resample_nearest", """
    SELECT p.scene, t.y, t.x, (p.g1 > 128)::INT AS v
    FROM (SELECT unnest(range(0, 12))::INT AS y) AS ty(y), (SELECT unnest(range(0, 12))::INT AS x) AS tx(x), LATERAL (SELECT ty.y, tx.x) t(y, x)
    JOIN v_pair p ON p.y = floor(8 / 12.0::DOUBLE * t.y)::INT AND p.x = floor(8 / 12.0::DOUBLE * t.x)::INT""")
def j12(spark, sf):
    mask = V.pair_blocks(spark, sf).withColumn("data", F.transform("g1", lambda g: F.when(g > 128, 1.0).otherwise(0.0)))
    out = grid.resample_nearest(mask, 12, 12, size=V.BLOCK)
    return B.to_pixels(out, keep=("scene",)).withColumn("v", F.col("v").cast("int"))


def morph_sql(source, steps):
    """Chained 3x3 minimum / maximum steps over (scene, y, x, v)."""
    body = source
    for step in steps:
        body = f"""(SELECT a.scene, a.y, a.x, {step}(b.v) AS v FROM {body} a JOIN {body} b
                    ON b.scene = a.scene AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)"""
    return body


MORPH = {
    "v_m0": "SELECT scene, y, x, CASE WHEN abs(g0 - g1) > 45 THEN 255 ELSE 0 END AS v FROM v_pair",
    **{f"v_m{i + 1}": f"SELECT * FROM {morph_sql(f'v_m{i}', [s])}" for i, s in enumerate(("min", "max", "max", "min"))},
}


@query("j13_morph_open_close", "SELECT scene, y, x, v FROM v_m4", MORPH)
def j13(spark, sf):
    mask = V.pair_blocks(spark, sf).withColumn(
        "data", F.zip_with("g0", "g1", lambda a, b: F.when(F.abs(a - b) > 45, 255).otherwise(0)))
    return B.to_pixels(grid.morph(mask, size=V.BLOCK), keep=("scene",))


@query("d3_stencil_kernel", "SELECT scene, y, x, v FROM v_m1", MORPH)
def d3(spark, sf):
    mask = V.pair_blocks(spark, sf).withColumn(
        "data", F.zip_with("g0", "g1", lambda a, b: F.when(F.abs(a - b) > 45, 255).otherwise(0)))
    return B.to_pixels(grid.morph(mask, ("min",), size=V.BLOCK), keep=("scene",))


@query("d6_explode_pixels", "SELECT scene, band, count(*) AS pixels, sum(y) AS sy, sum(x) AS sx FROM v_px GROUP BY ALL", types={"sy": "BIGINT", "sx": "BIGINT"})
def d6(spark, sf):
    return V.band_pixels(spark, sf).groupBy("scene", "band").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("y").alias("sy"), F.sum("x").alias("sx"))
