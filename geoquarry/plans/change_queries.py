"""Two-date change and registration queries."""

from pyspark.sql import functions as F

from geoquarry.operators import change, grid
from geoquarry.plans import views as V
from geoquarry.plans.pixel_queries import morph_sql
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import EXTRA as SCENE_VIEWS, guarded, six

EXTRA = {
    **SCENE_VIEWS,
    "v_h0": """
        SELECT scene, level, sum(c) OVER (PARTITION BY scene ORDER BY level) / sum(c) OVER (PARTITION BY scene) AS q
        FROM (SELECT scene, g0 AS level, count(*) AS c FROM v_pair GROUP BY ALL)""",
    "v_h1": """
        SELECT scene, level, sum(c) OVER (PARTITION BY scene ORDER BY level) / sum(c) OVER (PARTITION BY scene) AS q
        FROM (SELECT scene, g1 AS level, count(*) AS c FROM v_pair GROUP BY ALL)""",
    "v_lut": """
        SELECT scene, level, trunc(greatest(0.0, least(255.0, CASE WHEN ak IS NULL THEN bk WHEN bk IS NULL THEN ak
                 ELSE ((bk - ak) / (bq - aq)) * (q - aq) + ak END)))::INT AS matched
        FROM (SELECT s.scene, s.level, s.q, max(t.q) FILTER (t.q <= s.q) AS aq, max(t.level) FILTER (t.q <= s.q) AS ak,
                     min(t.q) FILTER (t.q > s.q) AS bq, min(t.level) FILTER (t.q > s.q) AS bk
              FROM v_h1 s JOIN v_h0 t USING (scene) GROUP BY s.scene, s.level, s.q)""",
    "v_diff": "SELECT p.scene, y, x, l0, l1, abs(g0 - matched) AS d FROM v_pair p JOIN v_lut l ON l.scene = p.scene AND l.level = g1",
    "v_between": """
        SELECT scene, level, CASE WHEN n0 < n THEN (n0 / n) * (1 - n0 / n) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) ELSE -1 END AS v
        FROM (SELECT scene, level, sum(c) OVER w AS n0, sum(c * level) OVER w AS s0, sum(c) OVER (PARTITION BY scene) AS n, sum(c * level) OVER (PARTITION BY scene) AS s
              FROM (SELECT scene, d AS level, count(*) AS c FROM v_diff GROUP BY ALL) WINDOW w AS (PARTITION BY scene ORDER BY level))""",
    "v_otsu": """
        SELECT scene, CASE WHEN v > 0 THEN level ELSE 0 END AS threshold, greatest(v, 0) AS variance
        FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY v DESC, level) AS r FROM v_between) WHERE r = 1""",
    "v_c0": "SELECT scene, y, x, CASE WHEN d > threshold THEN 255 ELSE 0 END AS v FROM v_diff JOIN v_otsu USING (scene)",
    **{f"v_c{i + 1}": f"SELECT * FROM {morph_sql(f'v_c{i}', [s])}" for i, s in enumerate(("min", "max", "max", "min"))},
    "v_stats": """
        SELECT scene, avg(d) AS diff_mean, max(d) AS diff_max, any_value(threshold) AS threshold, count(*) AS total_pixels, any_value(c.changed_pixels) AS changed_pixels, any_value(c.changed_pixels) / count(*) AS changed_fraction
        FROM v_diff JOIN v_otsu USING (scene) JOIN (SELECT scene, sum((v > 0)::INT) AS changed_pixels FROM v_c4 GROUP BY scene) c USING (scene) GROUP BY scene""",
    "v_conf": """
        SELECT scene, n, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
               CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou, (tp + fn) / n AS gt, (tp + fp) / n AS pr
        FROM (SELECT scene, count(*) AS n, sum((v > 0 AND l0 <> l1)::INT) AS tp, sum((v > 0 AND l0 = l1)::INT) AS fp, sum((v = 0 AND l0 <> l1)::INT) AS fn
              FROM v_c4 JOIN v_diff USING (scene, y, x) GROUP BY scene)""",
    "v_ham": """
        SELECT a.kp AS kp0, b.kp AS kp1, a.x AS u, a.y AS v, b.x, b.y,
               bit_count(xor(a.d0, b.d0))::INT + bit_count(xor(a.d1, b.d1))::INT + bit_count(xor(a.d2, b.d2))::INT + bit_count(xor(a.d3, b.d3))::INT AS distance
        FROM v_desc a, v_desc b WHERE a.image = 0 AND b.image = 1 AND a.kp // 50 = b.kp // 50""",
    "v_match": """
        SELECT kp0, kp1, u, v, x, y, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY kp0 ORDER BY distance, kp1) AS r0, row_number() OVER (PARTITION BY kp1 ORDER BY distance, kp0) AS r1 FROM v_ham)
        WHERE r0 = 1 AND r1 = 1""",
    "v_moment": """
        SELECT (kp0 // 50)::INT AS pair, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(x * x + y * y) AS sq,
               sum(x * u + y * v) AS along, sum(x * v - y * u) AS across FROM v_match WHERE distance < 50 GROUP BY ALL""",
    "v_l0": "SELECT scene, y, x, CASE WHEN abs(g0 - g1) > 45 THEN 255 ELSE 0 END AS v FROM v_pair",
}
COMPONENTS = """
    WITH RECURSIVE reach(scene, y, x, id) AS (
      SELECT scene, y, x, y * 8 + x FROM v_l0 WHERE v > 0
      UNION SELECT b.scene, b.y, b.x, a.id FROM reach a JOIN v_l0 b ON b.scene = a.scene AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 WHERE b.v > 0)
    SELECT scene, id, count(*) AS area FROM (SELECT scene, y, x, min(id) AS id FROM reach GROUP BY ALL) GROUP BY scene, id"""
EXTRA["v_comp"] = COMPONENTS


def simple_mask(spark, sf):
    diff = V.pair_blocks(spark, sf).withColumn("data", F.zip_with("g0", "g1", lambda a, b: F.abs(a - b)))
    return grid.legacy_mask(diff)


def keypoints(spark, sf, size=50):
    """Keypoints of the two images of each pair, ``size`` a pair."""
    rows = V.descriptors(spark, sf).withColumn("pair", F.floor(F.col("kp") / size).cast("int"))
    return rows.where("image = 0").drop("image"), rows.where("image = 1").drop("image")


def matched(spark, sf):
    first, second = keypoints(spark, sf)
    return change.match_descriptors(first, second)


@query("w3_histogram_match", "SELECT scene, level, matched FROM v_lut", EXTRA)
def w3(spark, sf):
    return change.match_table(V.pair_blocks(spark, sf))


@query("w3_difference", "SELECT scene, d AS level, count(*) AS pixels FROM v_diff GROUP BY ALL", EXTRA)
def w3_difference(spark, sf):
    return change.histogram(change.difference(V.pair_blocks(spark, sf)), "data").withColumnRenamed("count", "pixels")


@query("a4_otsu", "SELECT scene, threshold, round(variance, 6) AS variance FROM v_otsu", EXTRA)
def a4(spark, sf):
    return change.otsu(change.difference(V.pair_blocks(spark, sf))).withColumn("variance", F.round("variance", 6))


@query("w4_class_moments", """
    SELECT scene, level, round(v, 6) + 0.0 AS variance FROM v_between WHERE v >= 0""", EXTRA)
def w4(spark, sf):
    sums = change.class_variance(change.difference(V.pair_blocks(spark, sf)))
    return sums.where(F.col("variance").isNotNull()).select("scene", "level", six("variance"))


@query("a5_diff_stats", """
    SELECT scene, round(diff_mean, 6) AS diff_mean, diff_max, threshold, total_pixels, changed_pixels, round(changed_fraction, 6) AS changed_fraction FROM v_stats""", EXTRA, types={"changed_pixels": "BIGINT"})
def a5(spark, sf):
    rows = change.diff_stats(V.pair_blocks(spark, sf), size=V.BLOCK)
    return rows.withColumns({"diff_mean": F.round("diff_mean", 6), "changed_fraction": F.round("changed_fraction", 6)})


@query("a6_components", "SELECT scene, area, count(*) AS components FROM v_comp GROUP BY ALL", EXTRA)
def a6_components(spark, sf):
    return grid.components(simple_mask(spark, sf)).groupBy("scene", "area").agg(F.count(F.lit(1)).alias("components"))


@query("a6_mask_quality", """
    SELECT scene, round(intensity, 6) AS intensity, reg_conf, coalesce(snr, 0) AS snr_db, coalesce(coh, 0) AS coherence,
           round(reg_conf * 0.4 + coalesce(coh, 0) / 100 * 0.6, 6) AS trust,
           CASE WHEN reg_conf * 0.4 + coalesce(coh, 0) / 100 * 0.6 > 0.45 THEN 'VERIFIED GEOGRAPHIC CHANGE' ELSE 'SIGNAL INCONCLUSIVE' END AS verdict
    FROM (SELECT scene, sum((v > 0)::INT) / count(*) * 100 AS intensity, ((scene % 10) / 8.0)::DOUBLE AS reg_conf FROM v_l0 GROUP BY scene)
    LEFT JOIN (SELECT scene, round(10 * log10(signal / (noise + 1e-6) + 1e-7), 2) AS snr, round(signal / (signal + noise + 1e-6) * 100, 2) AS coh
               FROM (SELECT scene, coalesce(sum(area) FILTER (area >= 100), 0) AS signal, coalesce(sum(area) FILTER (area < 100), 0) AS noise FROM v_comp GROUP BY scene)) USING (scene)""", EXTRA)
def a6_quality(spark, sf):
    reg = V.scenes(spark, sf).select("scene", (F.col("scene") % 10 / 8.0).alias("reg_conf"))
    rows = grid.mask_quality(simple_mask(spark, sf), reg)
    return rows.withColumns({"intensity": F.round("intensity", 6), "trust": F.round("trust", 6)})


@query("a7_mask_scores", """
    SELECT scene, n, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(iou, 6) AS iou, false AS bad FROM v_conf""", EXTRA, types={"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT"})
def a7_scores(spark, sf):
    pair = V.pair_blocks(spark, sf)
    rows = change.mask_scores(change.change_mask(pair, V.BLOCK), change.truth_mask(pair))
    return rows.select("scene", "n", "tp", "fp", "fn", six("precision"), six("recall"), six("iou"), "bad")


@query("a7_mask_metrics", """
    SELECT count(*) AS n, 0 AS errors, round(avg(precision), 6) AS precision, round(stddev_pop(precision), 6) AS precision_sd, round(avg(recall), 6) AS recall,
           round(avg(iou), 6) AS iou, round(avg(gt), 6) AS gt_change_rate, round(avg(pr), 6) AS pred_change_rate, round(avg(gt), 6) AS baseline_precision FROM v_conf""", EXTRA)
def a7(spark, sf):
    pair = V.pair_blocks(spark, sf)
    rows = change.mask_metrics(change.change_mask(pair, V.BLOCK), change.truth_mask(pair))
    return rows.select("n", "errors", *[six(c) for c in rows.columns if c not in ("n", "errors")])


@query("j14_match_descriptors", "SELECT kp0, kp1, distance FROM v_match", EXTRA)
def j14(spark, sf):
    return matched(spark, sf).select("kp0", "kp1", "distance")


@query("j14_near_matches", "SELECT kp0, kp1, distance FROM v_match WHERE distance < 50", EXTRA)
def j14_near(spark, sf):
    return change.match_near(*keypoints(spark, sf)).select("kp0", "kp1", "distance")


@query("j14_registration", """
    SELECT pair, keypoints AS keypoints_t0, keypoints AS keypoints_t1, good,
           CASE WHEN good < 3 THEN least(good / 25.0, 0.15) ELSE least(good / 25.0, 1.0) END AS confidence,
           CASE WHEN good < 3 THEN 'no_warp_fallback' ELSE 'orb_affine' END AS mechanism
    FROM (SELECT (vec_id // 50)::INT AS pair, count(*) AS keypoints FROM embeddings GROUP BY ALL)
    LEFT JOIN (SELECT (kp0 // 50)::INT AS pair, count(*) AS good FROM v_match WHERE distance < 50 GROUP BY ALL) USING (pair)""", EXTRA)
def j14_registration(spark, sf):
    first, second = keypoints(spark, sf)
    return change.registration(matched(spark, sf), first, second)


@query("l6_sorted_matches", "SELECT kp0, distance, row_number() OVER (PARTITION BY kp0 // 50 ORDER BY distance, kp0) - 1 AS position FROM v_match WHERE distance < 50", EXTRA)
def l6(spark, sf):
    good = change.good_matches(matched(spark, sf))
    return change.ordered_matches(good)


@query("a26_fit_similarity", """
    SELECT pair, n, round(a, 6) AS a, round(b, 6) AS b, round((su - a * sx + b * sy) / n, 4) AS tx, round((sv - b * sx - a * sy) / n, 4) AS ty,
           round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 5) AS rotation
    FROM (SELECT *, (along - (sx * su + sy * sv) / n) / (sq - (sx * sx + sy * sy) / n) AS a,
                 (across - (sx * sv - sy * su) / n) / (sq - (sx * sx + sy * sy) / n) AS b FROM v_moment)""", EXTRA)
def a26(spark, sf):
    rows = change.fit_similarity(matched_points(spark, sf))
    return rows.select("pair", "n", *[F.round(c, d).alias(c) for c, d in DIGITS.items()])


DIGITS = {"a": 6, "b": 6, "tx": 4, "ty": 4, "scale": 6, "rotation": 5}


def matched_points(spark, sf):
    """Both positions of each good match."""
    first, second = keypoints(spark, sf)
    good = change.good_matches(matched(spark, sf))
    return good.join(first.select("pair", F.col("kp").alias("kp0"), F.col("x").alias("u"), F.col("y").alias("v")), ["pair", "kp0"]).join(
        second.select("pair", F.col("kp").alias("kp1"), "x", "y"), ["pair", "kp1"])


def _trimmed_sql(rounds=change.REFITS, keep=change.KEEP):
    """Fits of the trimmed points, round by round, as further views."""
    fit = """
        SELECT pair, a, b, (su - a * sx + b * sy) / n AS tx, (sv - b * sx - a * sy) / n AS ty
        FROM (SELECT *, (along - (sx * su + sy * sv) / n) / (sq - (sx * sx + sy * sy) / n) AS a, (across - (sx * sv - sy * su) / n) / (sq - (sx * sx + sy * sy) / n) AS b FROM (
          SELECT pair, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(x * x + y * y) AS sq, sum(x * u + y * v) AS along, sum(x * v - y * u) AS across
          FROM {points} GROUP BY pair))"""
    views = {
        "v_bad": """
            SELECT (kp0 // 50)::INT AS pair, x, y, u + CASE WHEN kp0 % 10 < 3 THEN 60.0 + kp0 % 7 * 25.0 ELSE 0.0 END AS u, v - CASE WHEN kp0 % 10 < 3 THEN kp0 % 5 * 30.0 ELSE 0.0 END AS v
            FROM v_match WHERE distance < 50""",
        "v_fit0": fit.format(points="v_bad"),
    }
    for i in range(rounds):
        views[f"v_off{i}"] = f"""
            SELECT p.*, pow(a * x - b * y + tx - u, 2) + pow(b * x + a * y + ty - v, 2) AS off FROM v_bad p JOIN v_fit{i} USING (pair)"""
        views[f"v_kept{i}"] = f"""
            SELECT o.* FROM v_off{i} o JOIN (SELECT pair, max(off) FILTER (r <= ceil({keep} * n)) AS most FROM (
              SELECT pair, off, row_number() OVER (PARTITION BY pair ORDER BY off) AS r, count(*) OVER (PARTITION BY pair) AS n FROM v_off{i}) GROUP BY pair) USING (pair) WHERE off <= most"""
        views[f"v_fit{i + 1}"] = fit.format(points=f"v_kept{i}")
    return views


@query("a26_trimmed_fit", f"""
    SELECT pair, round(a, 6) AS a, round(b, 6) AS b, round(tx, 4) AS tx, round(ty, 4) AS ty, round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 5) AS rotation
    FROM v_fit{change.REFITS}""", {**EXTRA, **_trimmed_sql()})
def a26_trimmed(spark, sf):
    # three matches in ten are wrong
    wrong, k = F.col("kp0") % 10 < 3, F.col("kp0")
    points = matched_points(spark, sf).withColumns({
        "u": F.col("u") + F.when(wrong, 60.0 + k % 7 * 25.0).otherwise(0.0), "v": F.col("v") - F.when(wrong, k % 5 * 30.0).otherwise(0.0)})
    return change.fit_trimmed(points).select("pair", *[F.round(c, d).alias(c) for c, d in DIGITS.items()])


@query("p30_change_text", """
    SELECT s.scene, 'Bi-temporal change analysis, t0 ' || modality || ' (' || band_count || '-band) vs t1 ' || modality || ' (' || band_count || '-band). '
      || CASE s.scene % 3 WHEN 0 THEN 'registration skipped (t0/t1 already share CRS and transform)'
         WHEN 1 THEN 'ORB feature-based affine registration (' || s.scene || ' good matches, registration confidence ' || printf('%.2f', least(s.scene / 25.0, 1.0)) || ')'
         ELSE 'registration fallback, no warp applied (few matches; registration confidence ' || printf('%.2f', least(s.scene / 25.0, 1.0)) || ')' END
      || '. Differencing + morphological cleanup flags ' || printf('%.1f', changed_fraction * 100) || '% of pixels as changed.' AS text
    FROM v_stats s JOIN v_guard USING (scene)""", EXTRA)
def p30(spark, sf):
    stats = change.diff_stats(V.pair_blocks(spark, sf), size=V.BLOCK).join(guarded(spark, sf).select("scene", "modality", "band_count"), "scene")
    s = F.col("scene")
    mechanism = F.when(s % 3 == 0, "skip_already_coregistered").when(s % 3 == 1, "orb_affine").otherwise("no_warp_fallback")
    side = F.concat("modality", F.lit(" ("), F.col("band_count").cast("string"), F.lit("-band)"))
    text = change.change_text(
        mechanism, s, F.least(s / 25.0, F.lit(1.0)), F.lit("few matches"), F.col("changed_fraction"), F.lit(None).cast("string"), side, side)
    return stats.select("scene", text.alias("text"))


@query("p31_confidence", """
    SELECT scene, round((least(scene / 50.0, 1.0) + CASE WHEN scene % 2 = 0 THEN 0.8 ELSE 0.2 END + CASE WHEN changed_pixels > 0 THEN 1.0 ELSE 0.0 END) / 3, 6) AS change_confidence,
           CASE WHEN k >= 3 THEN 0.7 WHEN k >= 2 THEN 0.5 WHEN k >= 1 THEN 0.3 ELSE 0.1 END AS fusion_confidence
    FROM (SELECT *, least(3, changed_pixels) AS k FROM v_stats)""", EXTRA, types={"fusion_confidence": "DOUBLE"})
def p31(spark, sf):
    stats = change.diff_stats(V.pair_blocks(spark, sf), size=V.BLOCK)
    s = F.col("scene")
    value = change.change_confidence(F.least(s / 50.0, F.lit(1.0)), F.col("changed_pixels") > 0, s % 2 == 0)
    return stats.select("scene", F.round(value, 6).alias("change_confidence"),
                        change.fusion_confidence(F.least(F.lit(3), F.col("changed_pixels"))).alias("fusion_confidence"))
