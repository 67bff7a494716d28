"""Composed change and fusion results, checked against their contracts."""

from pyspark.sql import functions as F

from geoquarry.operators import change, embed, grid, results, sar, trace
from geoquarry.plans import views as V
from geoquarry.plans.change_queries import COMPONENTS, EXTRA as CHANGE_VIEWS, keypoints
from geoquarry.plans.embed_queries import EXTRA as EMBED_VIEWS, scores, top
from geoquarry.plans.pixel_queries import _SAR, morph_sql
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import guarded, six

_SIDE = "modality || ' (' || band_count || '-band)'"
EXTRA = {
    **CHANGE_VIEWS,
    "v_sided": """
        SELECT (vec_id // 4)::INT AS scene, (vec_id % 2)::INT AS t, name AS label, avg(score) AS score FROM v_score GROUP BY ALL""",
    "v_sided_pair": """
        SELECT coalesce(a.scene, b.scene) AS pair, coalesce(a.label, b.label) AS label, coalesce(a.score, 0.0) AS raw_t0, coalesce(b.score, 0.0) AS raw_t1
        FROM (SELECT * FROM v_sided WHERE t = 0) a FULL JOIN (SELECT * FROM v_sided WHERE t = 1) b ON a.scene = b.scene AND a.label = b.label""",
    "v_sided_delta": EMBED_VIEWS["v_delta"].replace("FROM v_pairs", "FROM v_sided_pair"),
    "v_sided_movers": """
        SELECT pair AS scene, string_agg(label || ' ' || CASE WHEN round(delta, 1) < 0 THEN '' ELSE '+' END || printf('%.1f', CASE WHEN round(delta, 1) = 0 THEN 0.0 ELSE delta END) || 'pp', ', ' ORDER BY rank) AS movers
        FROM v_sided_delta WHERE rank <= 3 GROUP BY pair""",
    "v_fixed": """
        SELECT g.scene, g.crs IS NOT NULL AS skip, coalesce(good, 0) AS good, CASE WHEN good IS NULL THEN 0.05 WHEN good < 3 THEN least(good / 25.0, 0.15) ELSE least(good / 25.0, 1.0) END AS found,
               coalesce(good >= 3, false) AS warped, good IS NULL AS blank
        FROM v_guard g LEFT JOIN (SELECT k.pair, coalesce(m.good, 0) AS good FROM (SELECT DISTINCT (vec_id // 4)::INT AS pair FROM embeddings) k
          LEFT JOIN (SELECT kp0 // 4 AS pair, count(*) AS good FROM v_own_match WHERE distance < 50 GROUP BY ALL) m USING (pair)) r ON r.pair = g.scene""",
    "v_own_ham": CHANGE_VIEWS["v_ham"].replace("// 50", "// 4"),
    "v_own_match": CHANGE_VIEWS["v_match"].replace("v_ham", "v_own_ham"),
    "v_set": """
        SELECT (vec_id // 4)::INT AS scene, list(DISTINCT name) FILTER (vec_id % 2 = 0) AS o, list(DISTINCT name) FILTER (vec_id % 2 = 1) AS r
        FROM (SELECT vec_id, name, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, name) AS rank FROM v_score) WHERE rank <= 5 GROUP BY ALL""",
    "v_set_agree": """
        SELECT scene, len(list_intersect(o, r)) AS a, len(list_filter(o, lambda x: NOT list_contains(r, x))) AS oo, len(list_filter(r, lambda x: NOT list_contains(o, x))) AS ro,
               len(list_distinct(list_concat(o, r))) AS u FROM (SELECT scene, coalesce(o, []) AS o, coalesce(r, []) AS r FROM v_set)""",
}


def facts(spark, sf):
    side = F.concat("modality", F.lit(" ("), F.col("band_count").cast("string"), F.lit("-band)"))
    return guarded(spark, sf).select(
        "scene", F.col("path").alias("path0"), F.col("path").alias("path1"), side.alias("side0"), side.alias("side1"), F.col("crs").isNotNull().alias("coregistered"))


def change_payloads(spark, sf):
    # a scene is registered by the keypoints of its own vectors
    first, second = keypoints(spark, sf, 4)
    found = change.registration(change.match_descriptors(first, second), first, second).withColumnRenamed("pair", "scene")
    sided = scores(spark, sf).groupBy(F.floor(F.col("vec_id") / 4).cast("int").alias("scene"), "label", (F.col("vec_id") % 2).alias("date")).agg(F.avg("score").alias("score"))
    deltas = embed.softmax_delta(embed.dated_delta(sided, ("scene",)), ("scene",))
    known = facts(spark, sf)
    return results.change_results(known, results.registered(known, found), change.diff_stats(V.pair_blocks(spark, sf), size=V.BLOCK), deltas)


def fusion_payloads(spark, sf):
    best = top(spark, sf).select(F.floor(F.col("vec_id") / 4).cast("int").alias("scene"), "label", (F.col("vec_id") % 2).alias("t"))
    side = lambda t: best.where(F.col("t") == t).select("scene", "label").distinct()
    return results.fusion_results(facts(spark, sf), embed.agreement(side(0), side(1), "scene"), sar.sar_physics(V.sar_blocks(spark, sf)))


def checked(rows):
    return trace.validate_results(rows).withColumn("violations", F.size("violations").cast("long"))


@query("change_results", f"""
    SELECT scene, text || CASE WHEN movers IS NULL THEN '' ELSE ' Largest encoder class-confidence shifts between the two dates: ' || movers || '.' END AS text,
           round((conf + 0.8 + 1.0) / 3, 6) AS confidence, mechanism, changed_pixels, 0::BIGINT AS violations FROM (
      SELECT scene, changed_pixels, movers, CASE WHEN skip THEN 1.0 ELSE found END AS conf,
             CASE WHEN skip THEN 'skip_already_coregistered' WHEN warped THEN 'orb_affine' ELSE 'no_warp_fallback' END AS mechanism,
             'Bi-temporal change analysis, t0 ' || {_SIDE} || ' vs t1 ' || {_SIDE} || '. ' ||
             CASE WHEN skip THEN 'registration skipped (t0/t1 already share CRS and transform)'
                  WHEN warped THEN 'ORB feature-based affine registration (' || good || ' good matches, registration confidence ' || printf('%.2f', found) || ')'
                  ELSE 'registration fallback, no warp applied (' || CASE WHEN blank THEN 'no features' ELSE 'few matches' END || '; registration confidence ' || printf('%.2f', found) || ')' END
             || '. Differencing + morphological cleanup flags ' || printf('%.1f', changed_fraction * 100) || '% of pixels as changed.' AS text
      FROM v_guard JOIN v_fixed USING (scene) JOIN v_stats USING (scene) LEFT JOIN v_sided_movers USING (scene))""", EXTRA, types={"changed_pixels": "BIGINT", "confidence": "DOUBLE"})
def change_result_rows(spark, sf):
    return checked(change_payloads(spark, sf)).select("scene", "text", six("confidence"), "mechanism", "changed_pixels", "violations")


@query("fusion_results", f"""
    SELECT scene, 'Cross-modal fusion of optical (' || {_SIDE} || ') and SAR (' || {_SIDE} || ') data. BEN predictions: ' || a || ' classes agree (' || printf('%.0f', round_even(a / greatest(u, 1) * 100, 1)) || '%), '
           || oo || ' optical-only, ' || ro || ' SAR-only.' || CASE WHEN p.n > 0 AND potential_water THEN ' SAR physics: potential water body detected (low VV backscatter).' ELSE '' END
           || CASE WHEN p.n > 0 AND built_up_possible THEN ' SAR physics: possible built-up area (high backscatter + double-bounce).' ELSE '' END AS text,
           CASE k WHEN 3 THEN 0.7 WHEN 2 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.1 END AS confidence, k AS sources, 0::BIGINT AS violations
    FROM (SELECT *, (a + oo > 0)::INT + (a + ro > 0)::INT + coalesce(n > 0, false)::INT AS k FROM v_guard JOIN v_set_agree USING (scene) LEFT JOIN ({_SAR}) USING (scene)) p""", EXTRA, types={"confidence": "DOUBLE", "sources": "INTEGER"})
def fusion_result_rows(spark, sf):
    return checked(fusion_payloads(spark, sf)).select("scene", "text", "confidence", "sources", "violations")


@query("a6_opened_mask", "SELECT scene, y, x, v FROM v_o4", {
    **CHANGE_VIEWS, "v_o0": "SELECT scene, y, x, v FROM v_l0",
    # a 5 x 5 step is two 3 x 3 steps
    **{f"v_o{i + 1}": f"SELECT * FROM {morph_sql(f'v_o{i}', [s])}" for i, s in enumerate(("min", "min", "max", "max"))}})
def a6_opened(spark, sf):
    from geoquarry.plans.change_queries import simple_mask
    from geoquarry.sources.blocks import to_pixels

    return to_pixels(grid.opened_mask(simple_mask(spark, sf), size=V.BLOCK), keep=("scene",))


def _quality_sql(mask, parts):
    """Quality of each scene from its mask and the areas of its components."""
    return f"""
        SELECT scene, round(intensity, 6) AS intensity, reg_conf, coalesce(snr, 0) AS snr_db, coalesce(coh, 0) AS coherence,
               round(reg_conf * 0.4 + coalesce(coh, 0) / 100 * 0.6, 6) AS trust,
               CASE WHEN reg_conf * 0.4 + coalesce(coh, 0) / 100 * 0.6 > 0.45 THEN 'VERIFIED GEOGRAPHIC CHANGE' ELSE 'SIGNAL INCONCLUSIVE' END AS verdict
        FROM (SELECT scene, sum((v > 0)::INT) / count(*) * 100 AS intensity, ((scene % 10) / 8.0)::DOUBLE AS reg_conf FROM {mask} GROUP BY scene)
        LEFT JOIN (SELECT scene, round(10 * log10(signal / (noise + 1e-6) + 1e-7), 2) AS snr, round(signal / (signal + noise + 1e-6) * 100, 2) AS coh
                   FROM (SELECT scene, coalesce(sum(area) FILTER (area >= 100), 0) AS signal, coalesce(sum(area) FILTER (area < 100), 0) AS noise FROM {parts} GROUP BY scene)) USING (scene)"""


@query("a6_opened_quality", _quality_sql("v_mo4", "v_mo_comp"), {
    "v_mo0": """
        SELECT scene, y, x, CASE WHEN v > 0.25 OR (scene % 4 = 0 AND y BETWEEN 2 AND 13 AND x BETWEEN 2 AND 13) OR (scene % 4 = 1 AND y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5)
                 OR (scene % 4 = 2 AND (y BETWEEN 0 AND 6 OR (y BETWEEN 9 AND 13 AND x BETWEEN 2 AND 6))) THEN 255 ELSE 0 END AS v
        FROM (SELECT (vec_id // 4)::INT AS scene, (vec_id % 4 // 2 * 8 + (p - 1) // 8)::INT AS y, (vec_id % 2 * 8 + (p - 1) % 8)::INT AS x, e::DOUBLE AS v
              FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings))""",
    **{f"v_mo{i + 1}": f"SELECT * FROM {morph_sql(f'v_mo{i}', [s])}" for i, s in enumerate(("min", "min", "max", "max"))},
    "v_mo_comp": COMPONENTS.replace("v_l0", "v_mo4").replace("y * 8 + x", "y * 16 + x")})
def a6_opened_quality(spark, sf):
    reg = V.scenes(spark, sf).select("scene", (F.col("scene") % 10 / 8.0).alias("reg_conf"))
    rows = grid.mask_quality(grid.opened_mask(V.mosaic_masks(spark, sf), size=V.SIDE), reg)
    return rows.withColumns({"intensity": F.round("intensity", 6), "trust": F.round("trust", 6)})


#: Band mappings as JSON, right and with one thing wrong: (mapping, violations).
MAPPINGS = [
    ('{"slots_filled": ["B02"], "slots_absent": ["B03", "VV"], "fill_strategy": "mean", "source_modality": "msi"}', 0),
    ('{"slots_filled": ["B02", 7], "slots_absent": [], "fill_strategy": "mean", "source_modality": "sar"}', 1),
    ('{"slots_filled": [], "slots_absent": [], "fill_strategy": null, "source_modality": "msi"}', 1),
    ('{"slots_filled": [], "slots_absent": [], "fill_strategy": "mean", "source_modality": "lidar"}', 1),
    ('{"slots_filled": [], "fill_strategy": "mean", "source_modality": "msi"}', 1),
]


@query("p26_band_mappings", f"SELECT event_id AS rid, ([{', '.join(str(n) for _, n in MAPPINGS)}])[event_id % {len(MAPPINGS)} + 1]::BIGINT AS violations FROM events")
def p26_bands(spark, sf):
    e = F.col("event_id")
    texts = F.array(*[F.lit(t) for t, _ in MAPPINGS])
    rows = V.load(spark, sf, "events").select(e.alias("rid"), F.element_at(texts, (e % len(MAPPINGS) + 1).cast("int")).alias("band_mapping"))
    return trace.validate_band_mappings(rows).select("rid", F.size("violations").cast("long").alias("violations"))
