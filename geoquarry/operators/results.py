"""Composed results of change and fusion runs: one conforming payload per scene."""

from pyspark.sql import functions as F

from geoquarry.operators.change import change_confidence, change_text, fusion_confidence, fusion_text
from geoquarry.operators.embed import mover_text

NO_FEATURES, FEW_MATCHES = "no features", "few matches"


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def registered(facts, found):
    """Registration of each scene: skipped for dates on one grid, else what the matches say, else none.

    ``facts`` has ``scene, coregistered``; ``found`` is the result of
    :func:`geoquarry.operators.change.registration` by ``scene``.
    """
    rows = facts.select("scene", "coregistered").join(found.select("scene", "good", "confidence", "mechanism", "keypoints_t0", "keypoints_t1"), "scene", "left")
    skip, blank = F.col("coregistered"), F.coalesce(F.least("keypoints_t0", "keypoints_t1"), F.lit(0)) == 0
    return rows.select(
        "scene",
        F.when(skip, "skip_already_coregistered").otherwise(F.coalesce("mechanism", F.lit("no_warp_fallback"))).alias("mechanism"),
        F.when(skip, 1.0).otherwise(F.coalesce("confidence", F.lit(0.05))).alias("registration_confidence"),
        F.when(~skip, F.coalesce("good", F.lit(0))).alias("good_matches"),
        F.when(blank, NO_FEATURES).otherwise(FEW_MATCHES).alias("reason"),
    )


def change_results(facts, registrations, stats, deltas):
    """One change payload per scene, with its text, confidence and evidence.

    ``facts``: scene, path0, path1, side0, side1 (modality and bands as text).
    ``stats`` is the result of ``diff_stats``; ``deltas`` that of ``softmax_delta``
    by ``scene``, at most a vocabulary per scene.  A scene without statistics is an
    error payload of confidence 0.
    """
    movers = mover_text(deltas, ("scene",))
    listed = deltas.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("label", "pct_t0", "pct_t1", "delta_pct"))).alias("per_class"))
    rows = facts.join(registrations, "scene", "left").join(stats, "scene", "left").join(movers, "scene", "left").join(listed, "scene", "left")
    mask = F.concat(F.lit("runs/change/"), F.col("scene").cast("string"), F.lit("/change_mask.png"))
    overlay = F.concat(F.lit("runs/change/"), F.col("scene").cast("string"), F.lit("/change_overlay.png"))
    good = F.col("total_pixels").isNotNull()
    text = change_text(
        F.col("mechanism"), F.col("good_matches"), F.col("registration_confidence"), F.col("reason"), F.col("changed_fraction"), F.col("movers"), F.col("side0"), F.col("side1")
    )
    failed = F.concat(F.lit("Change analysis failed: no pixels in "), F.col("path0"))
    rows = rows.withColumns({
        "text": F.when(good, text).otherwise(failed),
        "confidence": F.when(good, change_confidence(F.col("registration_confidence"), good, F.col("per_class").isNotNull())).otherwise(0.0),
    })
    metrics = F.struct("registration_confidence", F.col("changed_fraction").alias("changed_area_fraction"), F.col("per_class").alias("per_class_delta"))
    evidence = F.struct(
        F.col("path0").alias("t0_file"), F.col("path1").alias("t1_file"),
        F.struct("mechanism", F.col("registration_confidence").alias("confidence"), "good_matches", "reason").alias("registration"),
        F.struct("diff_mean", "diff_max", "threshold").alias("diff_stats"), F.struct("changed_pixels", "total_pixels").alias("mask_stats"),
    )
    payload = _json(
        text_response=F.col("text"), change_mask_path=F.when(good, mask), overlay_path=F.when(good, overlay), metrics=metrics,
        confidence=F.col("confidence"), confidence_basis=F.lit("heuristic"), evidence=evidence,
    )
    return rows.select("scene", F.lit("change").alias("task"), "text", "confidence", "mechanism", "changed_pixels", payload.alias("payload"))


def fusion_results(facts, agreements, physics):
    """One fusion payload per scene from labels of both sides and radar statistics.

    ``agreements`` is the result of ``agreement`` by ``scene``, ``physics`` that of
    ``sar_physics``.  Sources of evidence: optical labels, radar labels, physics.
    """
    rows = facts.join(agreements, "scene", "left").join(physics, "scene", "left")
    none = F.array().cast("array<string>")
    both, optical, radar = (F.coalesce(c, none) for c in ("agreement", "optical_only", "sar_only"))
    usable = F.coalesce(F.col("n") > 0, F.lit(False))
    sources = (F.size(both) + F.size(optical) > 0).cast("int") + (F.size(both) + F.size(radar) > 0).cast("int") + usable.cast("int")
    text = fusion_text(
        F.col("side0"), F.col("side1"), F.size(both), F.coalesce("agreement_pct", F.lit(0.0)), F.size(optical), F.size(radar),
        usable & F.col("potential_water"), usable & F.col("built_up_possible"),
    )
    confidence = fusion_confidence(sources)
    place = lambda name: F.concat(F.lit("runs/fusion/"), F.col("scene").cast("string"), F.lit(f"/{name}.png"))
    evidence = F.struct(
        F.col("path0").alias("optical_file"), F.col("path1").alias("sar_file"), both.alias("agreement"), optical.alias("optical_only"), radar.alias("sar_only"),
        F.struct("vv_mean", "water_fraction", "built_fraction", "potential_water", "built_up_possible", "error").alias("sar_physics"),
    )
    payload = _json(
        text_response=text, agreement_map_path=place("agreement_map"), overlay_path=place("overlay"), evidence=evidence,
        confidence=confidence, confidence_basis=F.lit("heuristic"),
    )
    return rows.select("scene", F.lit("fusion").alias("task"), text.alias("text"), confidence.alias("confidence"), sources.alias("sources"), payload.alias("payload"))
