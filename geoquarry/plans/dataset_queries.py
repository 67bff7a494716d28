"""Dataset assembly queries."""

from pyspark.sql import functions as F

from geoquarry.operators import dataset, evaluate
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import six
from geoquarry.session import scratch_path
from geoquarry.sources import files, qa

K, K1 = 5, 10
EXTRA = {
    "v_mark": f"""
        SELECT *, s2_folder IN (SELECT DISTINCT s2_folder FROM v_folder ORDER BY 1 LIMIT {K}) AS in_s2,
               s1_folder IN (SELECT DISTINCT s1_folder FROM v_folder ORDER BY 1 LIMIT {K1}) AS in_s1 FROM v_folder""",
    "v_file": f"""
        SELECT key, patch_id, s1_name, 'S2' AS side, band, 'BigEarthNet-S2/' || s2_folder || '/' || patch_id || '/' || patch_id || '_' || band || '.tif' AS path
        FROM v_folder, (SELECT unnest({dataset.S2_BANDS}) AS band)
        UNION ALL SELECT key, patch_id, s1_name, 'S1', band, 'BigEarthNet-S1/' || s1_folder || '/' || s1_name || '/' || s1_name || '_' || band || '.tif'
        FROM v_folder, (SELECT unnest({dataset.S1_BANDS}) AS band)""",
    "v_listing": """
        SELECT DISTINCT path FROM v_file EXCEPT SELECT path FROM v_file WHERE key % 29 = 0 AND band IN ('B03', 'VH')""",
    "v_check": """
        SELECT dataset, count(*) AS files, count(a.path) AS present, coalesce(sum(a.bytes), 0) AS present_bytes,
               count(*) FILTER (a.bytes <> e.bytes) AS size_problems, count(*) FILTER (a.bytes = e.bytes AND a.sha256 <> e.sha256) AS hash_problems
        FROM v_expected e LEFT JOIN v_actual a USING (dataset, path) GROUP BY dataset""",
}


def folders(spark, sf):
    return dataset.with_folders(V.patches(spark, sf))


def listing(spark, sf):
    """Files found: the expected ones less two bands of some patches."""
    every = dataset.expected_files(folders(spark, sf))
    gone = (F.col("key") % 29 == 0) & F.col("band").isin("B03", "VH")
    return every.groupBy("path").agg(F.max(gone).alias("gone")).where(~F.col("gone")).select("path")


def headers(spark, sf):
    """Stated totals; those of one dataset are wrong."""
    expected, _ = V.files(spark, sf)
    h = dataset.manifest_header(expected)
    return h.withColumn("total_bytes", F.col("total_bytes") + F.when(F.col("dataset") == "set_1", 1).otherwise(0))


@query("s7_read_captions", "SELECT 'p' || key AS patch_id, output FROM v_note WHERE type = 'captioning'")
def s7(spark, sf):
    path = scratch_path(spark, "annotations")
    V.annotations(spark, sf).withColumn("patch_id", F.concat(F.lit("p"), F.col("key").cast("string"))).write.parquet(path)
    return qa.read_captions(spark, path).select("patch_id", "output")


@query("s8_read_patches", "SELECT split, country, count(*) AS n FROM v_patch GROUP BY ALL")
def s8(spark, sf):
    path = scratch_path(spark, "patches")
    V.patches(spark, sf).write.parquet(path)
    return qa.read_patches(spark, path).groupBy("split", "country").agg(F.count(F.lit(1)).alias("n"))


@query("s9_target_list", """
    SELECT patch_id, key, 'images/BigEarthNet-S2/' || s2_folder AS s2_path, 'images/BigEarthNet-S1/' || s1_folder AS s1_path FROM v_mark WHERE in_s2 AND in_s1""", EXTRA)
def s9(spark, sf):
    path = scratch_path(spark, "targets")
    files.write_targets(dataset.pair_targets(V.patches(spark, sf), K, K1), path)
    return files.read_targets(spark, path).select("patch_id", "key", "s2_path", "s1_path")


@query("s10_list_files")
def s10(spark, sf):
    path = scratch_path(spark, "listing")
    V.load(spark, sf, "pages").write.option("maxRecordsPerFile", 100).parquet(path)
    rows = files.list_files(spark, f"{path}/*.parquet", root=path.rsplit("/", 1)[-1])
    return rows.select(F.length("path").alias("name_length"), "bytes", F.length("sha256").alias("digest_length"))


@query("s11_manifest", """
    SELECT dataset, 'FAIR' AS tier, count(*) AS file_count, sum(bytes) AS total_bytes, count(*) AS listed, CASE WHEN dataset = 'set_3' THEN 'manifest missing required field(s): root' END AS error
    FROM v_expected GROUP BY dataset""", types={"total_bytes": "BIGINT"})
def s11(spark, sf):
    expected, _ = V.files(spark, sf)
    # a null field is not written, so set_3 lacks its root; ``extra`` is unknown to the reader
    head = expected.select("dataset").distinct().select(
        "dataset", F.lit("mixed").alias("split"), F.lit("FAIR").alias("tier"), F.when(F.col("dataset") != "set_3", "images").alias("root"),
        F.array(F.lit("https://example.org/a")).alias("source_urls"), F.lit("2026-01-01T00:00:00Z").alias("retrieved_utc"), F.lit(1).alias("extra"))
    path = scratch_path(spark, "manifests")
    files.write_manifests(head, expected, path)
    back, entries = files.read_manifests(spark, path)
    listed = entries.groupBy("dataset").agg(F.count(F.lit(1)).alias("listed"))
    return back.select("dataset", "tier", "file_count", "total_bytes", "error").join(listed, "dataset")


@query("f23_sha256", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def f23(spark, sf):
    return V.load(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("f15_acquisition_folder", "SELECT key, s2_folder, s1_folder FROM v_folder")
def f15(spark, sf):
    return folders(spark, sf).select("key", "s2_folder", "s1_folder")


@query("f16_expected_files", "SELECT key, side, band, path FROM v_file", EXTRA)
def f16(spark, sf):
    return dataset.expected_files(folders(spark, sf)).select("key", "side", "band", "path")


@query("p15_split_rows", "SELECT key, patch_id FROM v_patch WHERE split = 'test'")
def p15(spark, sf):
    return dataset.split_rows(V.patches(spark, sf), "test").select("key", "patch_id")


@query("p16_filter_annotations", """
    SELECT id, type, category, season FROM v_note WHERE type IN ('captioning', 'mcq') AND category = 'water' AND season IN ('winter', 'spring')""")
def p16(spark, sf):
    return dataset.filter_annotations(
        V.annotations(spark, sf), type=["captioning", "mcq"], category=["water"], season=["winter", "spring"], climate_zone=None
    ).select("id", "type", "category", "season")


@query("w1_folder_rank", "SELECT s2_folder, dense_rank() OVER (ORDER BY s2_folder) - 1 AS rank FROM (SELECT DISTINCT s2_folder FROM v_folder)")
def w1(spark, sf):
    return dataset.folder_ranks(folders(spark, sf), "s2_folder")


@query("j5_pair_targets", "SELECT patch_id, key, s2_folder, s1_folder FROM v_mark WHERE in_s2 AND in_s1", EXTRA)
def j5(spark, sf):
    return dataset.pair_targets(V.patches(spark, sf), K, K1).select("patch_id", "key", "s2_folder", "s1_folder")


@query("j5_candidate_counts", """
    SELECT count(*) FILTER (in_s2) AS candidates_s2, count(*) FILTER (in_s1) AS candidates_s1, count(*) FILTER (in_s2 AND in_s1) AS paired FROM v_mark""", EXTRA)
def j5_counts(spark, sf):
    return dataset.candidate_counts(V.patches(spark, sf), K, K1)


@query("j6_verify_pairs", """
    SELECT key, count(*) FILTER (side = 'S2' AND l.path IS NULL) AS missing_s2_bands, count(*) FILTER (side = 'S1' AND l.path IS NULL) AS missing_s1_bands,
           count(*) FILTER (l.path IS NULL) = 0 AS kept FROM v_file f LEFT JOIN v_listing l USING (path) GROUP BY key""", EXTRA)
def j6(spark, sf):
    return dataset.verify_pairs(folders(spark, sf), listing(spark, sf)).drop("patch_id", "s1_name")


@query("j4_with_caption", """
    SELECT key, output AS caption FROM (SELECT key, output, row_number() OVER (PARTITION BY key ORDER BY id, output) AS r FROM v_note WHERE type = 'captioning') WHERE r = 1""")
def j4(spark, sf):
    return evaluate.with_caption(V.patches(spark, sf), V.annotations(spark, sf)).select("key", "caption")


@query("j7_verify_manifest", """
    SELECT dataset, CASE WHEN present = 0 THEN 'NOT_DOWNLOADED' WHEN files > present OR size_problems + hash_problems + hp > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
           files, present, present_bytes, files - present AS missing, size_problems, hash_problems, hp AS header_problems
    FROM (SELECT *, CASE WHEN dataset = 'set_1' THEN 1 ELSE 0 END AS hp FROM v_check)""", EXTRA, types={"present_bytes": "BIGINT"})
def j7(spark, sf):
    expected, actual = V.files(spark, sf)
    return dataset.verify_manifest(expected, actual, headers(spark, sf))


@query("j7_verify_manifest_fast", """
    SELECT dataset, CASE WHEN present = 0 THEN 'NOT_DOWNLOADED' WHEN files > present OR size_problems > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v_check""", EXTRA)
def j7_fast(spark, sf):
    expected, actual = V.files(spark, sf)
    return dataset.verify_manifest(expected, actual, fast=True).select("dataset", "status")


@query("j7_file_problems", """
    SELECT dataset, path, CASE WHEN a.bytes IS NULL THEN 'missing' WHEN a.bytes <> e.bytes THEN 'size mismatch (expected ' || e.bytes || ', got ' || a.bytes || ')' ELSE 'sha256 mismatch' END AS problem
    FROM v_expected e LEFT JOIN v_actual a USING (dataset, path) WHERE a.bytes IS NULL OR a.bytes <> e.bytes OR a.sha256 <> e.sha256""")
def j7_problems(spark, sf):
    return dataset.file_problems(*V.files(spark, sf))


@query("a16_label_columns", """
    SELECT key, list_contains(labels, 'ECONOMY')::INT AS is_ECONOMY, list_contains(labels, 'PROMO')::INT AS is_PROMO, list_contains(labels, 'absent')::INT AS is_absent FROM v_patch""")
def a16(spark, sf):
    from geoquarry.operators.embed import label_matrix

    return label_matrix(V.patches(spark, sf), ["ECONOMY", "PROMO", "absent"]).select("key", "is_ECONOMY", "is_PROMO", "is_absent")


@query("a17_label_set_ceiling", """
    SELECT sum(n)::BIGINT AS patches, count(*) AS distinct_sets, max(n) AS largest_set, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS shared_share, round(count(*) / sum(n), 6) AS best_r1
    FROM (SELECT labels, count(*) AS n FROM v_patch GROUP BY labels)""")
def a17(spark, sf):
    rows = evaluate.label_set_ceiling(V.patches(spark, sf))
    return rows.select("patches", "distinct_sets", "largest_set", six("shared_share"), six("best_r1"))


@query("a18_prevalence_floor", """
    SELECT count(*) AS classes, round(avg(n / (SELECT count(*) FROM v_patch)), 6) AS random_floor, round(sum(n) / (SELECT count(*) FROM v_patch), 6) AS labels_per_patch
    FROM (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM v_patch) GROUP BY label)""")
def a18(spark, sf):
    return evaluate.prevalence_floor(V.patches(spark, sf)).select("classes", six("random_floor"), six("labels_per_patch"))


@query("a19_summarize", """
    SELECT 'split' AS kind, split AS name, count(*) AS n FROM v_patch GROUP BY split UNION ALL SELECT 'country', country, count(*) FROM v_patch GROUP BY country UNION ALL
    SELECT 'class', label, count(*) FROM (SELECT unnest(labels) AS label FROM v_patch) GROUP BY label""")
def a19(spark, sf):
    return dataset.summarize(V.patches(spark, sf))


@query("a19_kept_sketches", """
    SELECT 'split' AS kind, split AS name, count(*) AS n, true AS close FROM v_patch GROUP BY split
    UNION ALL SELECT 'country', country, count(*), true FROM v_patch GROUP BY country""")
def a19_sketches(spark, sf):
    # yesterday's patches are known by their stored sketches only
    rows = V.patches(spark, sf)
    old, new = rows.where("key % 3 > 0"), rows.where("key % 3 = 0")
    path = scratch_path(spark, "sketches")
    dataset.sketches(old).write.parquet(path)
    counts = dataset.distinct_counts(dataset.merged(spark.read.parquet(path), dataset.sketches(new)))
    exact = rows.groupingSets([["split"], ["country"]], "split", "country").agg(F.countDistinct("key").alias("exact"))
    exact = exact.select(F.when(F.col("split").isNotNull(), "split").otherwise("country").alias("kind"), F.coalesce("split", "country").alias("name"), "exact")
    # four standard errors
    near = F.abs(F.col("key") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (dataset.SKETCH_BITS / 2) * F.col("exact"))
    return counts.join(exact, ["kind", "name"]).select("kind", "name", "n", near.alias("close"))


@query("a20_project_bytes", f"""
    SELECT paired, floor(least({K}, n2) / n2 * 63251710377 + least({K1}, n1) / n1 * 54439153171)::BIGINT AS streamed_bytes, paired * 281000 AS stored_bytes
    FROM (SELECT count(DISTINCT s2_folder) AS n2, count(DISTINCT s1_folder) AS n1, count(*) FILTER (in_s2 AND in_s1) AS paired FROM v_mark)""", EXTRA)
def a20(spark, sf):
    return dataset.project_bytes(V.patches(spark, sf), K, K1)


@query("a21_manifest_header", """
    SELECT dataset, count(*) AS file_count, sum(bytes) AS total_bytes, 'large=' || count(*) FILTER (bytes > 5000) || ',small=' || count(*) FILTER (bytes <= 5000) AS counts
    FROM v_expected GROUP BY dataset""", types={"total_bytes": "BIGINT"})
def a21(spark, sf):
    expected, _ = V.files(spark, sf)
    per = expected.groupBy("dataset").agg(
        F.count(F.when(F.col("bytes") > 5000, 1)).alias("large"), F.count(F.when(F.col("bytes") <= 5000, 1)).alias("small"))
    counts = per.select("dataset", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("large", "small")])).alias("c")).select("dataset", "c.*")
    rows = dataset.manifest_header(expected, counts)
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("dataset", "file_count", "total_bytes", shown.alias("counts"))


@query("u4_class_coverage", """
    SELECT string_agg(label, '|' ORDER BY label) AS classes_covered, count(*) AS classes_covered_count FROM (SELECT DISTINCT unnest(labels) AS label FROM v_patch)""")
def u4(spark, sf):
    return dataset.class_coverage(V.patches(spark, sf))


@query("l4_prefix", "SELECT patch_id, key FROM v_patch WHERE split = 'train' ORDER BY patch_id, key LIMIT 600")
def l4(spark, sf):
    return evaluate.prefix(dataset.split_rows(V.patches(spark, sf), "train"), ["patch_id", "key"], 600).select("patch_id", "key")


@query("l5_seeded_training_subset", "SELECT key FROM v_patch WHERE split = 'train' ORDER BY (key * 2654435761 + 7) % 4294967296, key LIMIT 600")
def l5(spark, sf):
    return evaluate.seeded_subset(dataset.split_rows(V.patches(spark, sf), "train"), "key", 600, seed=7).select("key")


@query("l7_sorted_outputs", "SELECT key, array_to_string(labels, ',') AS labels FROM v_patch")
def l7(spark, sf):
    return V.patches(spark, sf).select("key", F.array_join(F.array_sort("labels"), ",").alias("labels")).orderBy("key")
