"""Benchmark, text metric and box queries."""

from pyspark.sql import functions as F

from geoquarry.functions import text
from geoquarry.functions.geo import ring
from geoquarry.operators import boxes, dataset, evaluate
from geoquarry.operators.change import grounding_text
from geoquarry.operators.routing import route
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.routing_queries import EXTRA as ROUTING_VIEWS
from geoquarry.plans.scene_queries import six
from geoquarry.session import scratch_path
from geoquarry.sources import files, qa

_NORM = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"
_TOK = "regexp_extract_all(lower({0}), '[0-9a-z]+')"
norm = _NORM.format
tok = _TOK.format
_REF = "{'ymin': rymin, 'xmin': rxmin, 'ymax': rymax, 'xmax': rxmax}"
EXTRA = {
    **ROUTING_VIEWS,
    "v_item": """
        SELECT qid, img_id, type, question, gold, prediction, file_name, path FROM v_qa LEFT JOIN v_image USING (img_id) WHERE active""",
    "v_answer": f"""
        SELECT *, prediction = gold AS raw_match, {norm('prediction')} = {norm('gold')} AS norm_match,
               len({tok('gold')}) > 0 AND list_has_all({tok('prediction')}, {tok('gold')}) AS answer_match,
               CASE WHEN len({tok('gold')}) = 0 OR len({tok('prediction')}) = 0 THEN 0.0
                    ELSE least(1.0, CASE WHEN len({tok('prediction')}) > len({tok('gold')}) THEN 1.0
                           ELSE pow(2.718281828, 1 - len({tok('gold')}) / len({tok('prediction')})) END
                         * len(list_filter({tok('prediction')}, lambda w: list_contains({tok('gold')}, w))) / len({tok('prediction')})) END AS bleu1
        FROM v_item""",
    "v_task": "SELECT *, qr.task AS routed_task FROM v_answer JOIN (SELECT qid, task FROM v_routed) qr USING (qid)",
    "v_side": f"SELECT id, {tok('ref')} AS r, {tok('cand')} AS c FROM v_cap",
    "v_word": """
        SELECT id, side, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, pos FROM (
          SELECT id, 'r' AS side, unnest(r) AS w, unnest(range(0, len(r))) AS pos FROM v_side UNION ALL
          SELECT id, 'c', unnest(c), unnest(range(0, len(c))) FROM v_side) WINDOW o AS (PARTITION BY id, side ORDER BY pos)""",
    "v_gram": """
        SELECT id, n, gram, count(*) FILTER (side = 'r') AS in_ref, count(*) FILTER (side = 'c') AS in_cand FROM (
          SELECT id, side, 1 AS n, w1 AS gram FROM v_word UNION ALL
          SELECT id, side, 2, w1 || ' ' || w2 FROM v_word WHERE w2 IS NOT NULL UNION ALL
          SELECT id, side, 3, w1 || ' ' || w2 || ' ' || w3 FROM v_word WHERE w3 IS NOT NULL UNION ALL
          SELECT id, side, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v_word WHERE w4 IS NOT NULL) GROUP BY id, n, gram""",
    "v_level": """
        SELECT id, n, sum(CASE WHEN in_ref > 0 THEN in_cand ELSE 0 END) AS hits, sum(least(in_ref, in_cand)) AS clipped, sum(in_cand) AS total, sum(in_ref) AS ref_total
        FROM v_gram GROUP BY id, n""",
    "v_pen": """
        SELECT id, CASE WHEN len(c) > len(r) THEN 1.0 ELSE pow(2.718281828, 1 - len(r) / greatest(len(c), 1)) END AS bp, len(c) AS nc, len(r) AS nr FROM v_side""",
    "v_bleu": """
        SELECT id, CASE WHEN nc = 0 OR nr = 0 OR low = 0 THEN 0.0 ELSE least(1.0, bp * (roots + 4 - levels) / 4) END AS bleu,
               CASE WHEN nc = 0 OR nr = 0 OR lowc = 0 THEN 0.0 ELSE bp * exp(logs) END AS bleu_clipped
        FROM v_pen LEFT JOIN (
          SELECT id, sum(pow(CASE WHEN total > 0 THEN hits / total ELSE 1.0 END, 0.25)) AS roots, count(*) AS levels,
                 min(CASE WHEN total > 0 THEN hits / total ELSE 1.0 END) AS low, min(clipped) FILTER (total > 0) AS lowc,
                 avg(ln(clipped / total)) FILTER (total > 0 AND clipped > 0) AS logs FROM v_level GROUP BY id) USING (id)""",
    "v_cider": """
        SELECT id, coalesce(s, 0.0) AS cider FROM v_side LEFT JOIN (
          SELECT id, CASE WHEN sum(in_ref * in_ref) * sum(in_cand * in_cand) = 0 THEN 0.0
                 ELSE sum(in_ref * in_cand) / (sqrt(sum(in_ref * in_ref)) * sqrt(sum(in_cand * in_cand))) END AS s FROM v_gram WHERE n = 1 GROUP BY id) USING (id)""",
    "v_nbox": """
        SELECT image_id, ord, item, CASE WHEN trim(label) = '' OR regexp_full_match(trim(label), '[0-9]+') THEN 'ship' ELSE trim(label) END AS label, score AS confidence,
               least(ymin, ymax) AS ymin, least(xmin, xmax) AS xmin, greatest(ymin, ymax) AS ymax, greatest(xmin, xmax) AS xmax FROM v_box""",
    "v_ref": """
        SELECT image_id, ord, item, n[2]::DOUBLE / 100 * h AS rymin, n[1]::DOUBLE / 100 * w AS rxmin, n[4]::DOUBLE / 100 * h AS rymax, n[3]::DOUBLE / 100 * w AS rxmax, len(n) = 4 AS ok
        FROM (SELECT *, regexp_extract_all(raw, '<([0-9]+)>', 1) AS n FROM v_box)""",
    "v_iou": """
        SELECT image_id, ord, item, CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS iou FROM (
          SELECT *, (ymax - ymin) * (xmax - xmin) + (rymax - rymin) * (rxmax - rxmin) - i AS u FROM (
            SELECT *, greatest(0.0, least(xmax, rxmax) - greatest(xmin, rxmin)) * greatest(0.0, least(ymax, rymax) - greatest(ymin, rymin)) AS i
            FROM v_nbox JOIN v_ref USING (image_id, ord, item) WHERE ok))""",
    "v_bestbox": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, ord, item, label, ymin, xmin, ymax, xmax) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM v_nbox) WHERE r = 1""",
    "v_cqa": """
        SELECT *, regexp_matches(regexp_replace(replace(lower(prediction), '_', ' '), '\\s+', ' ', 'g'), '\\b' || gold || '\\b') AS correct FROM v_item""",
}


def items(spark, sf):
    q = V.answers(spark, sf)
    asked = q.select("qid", "img_id", "type", "question", "file_name", "active")
    told = q.select("qid", "gold", "prediction")
    return evaluate.vqa_items(asked, told, V.qa_images(spark, sf))


def routed_items(spark, sf):
    tasks = route(V.queries(spark, sf)).select("qid", F.col("task").alias("routed_task"))
    return items(spark, sf).join(tasks, "qid")


def predicted(spark, sf):
    return boxes.norm_boxes(V.boxes(spark, sf), F.lit("ship"))


def reference(spark, sf):
    box = boxes.parse_ref_box(F.col("raw"), F.col("w"), F.col("h"))
    return V.boxes(spark, sf).select("image_id", "ord", "item", box.alias("box")).where("box is not null")


def referring(spark, sf):
    """Referring rows, with a null box where the text cannot be read."""
    box = boxes.parse_ref_box(F.col("raw"), F.col("w"), F.col("h"))
    return V.boxes(spark, sf).select("image_id", "ord", "item", box.alias("box"))


@query("s5_read_split", "SELECT qid, type, question FROM v_qa WHERE active")
def s5(spark, sf):
    rows = V.answers(spark, sf).select("qid", "type", "question", "active")
    path = scratch_path(spark, "questions")
    # wrapped objects of at most a thousand questions each
    rows.withColumn("_doc", F.floor(F.col("qid") / 1000)).groupBy("_doc").agg(
        F.collect_list(F.struct("qid", "type", "question", "active")).alias("questions")).drop("_doc").write.json(path)
    return qa.read_split(spark, path, "questions", "qid bigint, type string, question string, active boolean", whole_files=False).drop("active")


@query("s6_read_annotations", "SELECT id, image_id, len(ref) AS n FROM v_cap")
def s6(spark, sf):
    path = scratch_path(spark, "captions")
    V.captions(spark, sf).select("id", "image_id", "ref").write.json(path)
    rows = qa.read_annotations(spark, path, "id bigint, image_id int, ref string", whole_files=False)
    return rows.select("id", "image_id", F.length("ref").cast("long").alias("n"))


@query("j1_vqa_items", "SELECT qid, img_id, type, gold, path FROM v_item", EXTRA)
def j1(spark, sf):
    return items(spark, sf).select("qid", "img_id", "type", "gold", "path")


@query("j2_change_items", """
    SELECT 'tile_' || (img_id // 4) || '.png' AS file_name, count(*) AS n_questions FROM v_qa WHERE active AND img_id % 7 <> 0 AND img_id % 11 <> 0 GROUP BY ALL""")
def j2(spark, sf):
    q = V.answers(spark, sf)
    # four image ids share a file
    name = F.concat(F.lit("tile_"), F.floor(F.col("img_id") / 4).cast("string"), F.lit(".png"))
    images = q.select("img_id").distinct().select(
        "img_id", (F.col("img_id") % 7 != 0).alias("has_t0"), (F.col("img_id") % 11 != 0).alias("has_t1"), F.lit(True).alias("active"),
        name.alias("file_name"))
    asked = q.select("qid", "img_id", "type", "question", "active")
    told = q.select("qid", "gold", F.lit(None).cast("boolean").alias("active"))
    return evaluate.change_pairs(evaluate.change_items(images, asked, told))


@query("w8_first_per_key", "SELECT image_id, min(id) AS id, arg_min(len(ref), id) AS n FROM v_cap GROUP BY image_id")
def w8(spark, sf):
    rows = V.captions(spark, sf).select("image_id", "id", F.length("ref").cast("long").alias("n"))
    return evaluate.first_per_key(rows, ["image_id"], "id")


@query("j3_caption_items", """
    SELECT c.id, c.image_id, coalesce(t.target, 'the main object') AS target FROM v_cap c LEFT JOIN (
      SELECT image_id, arg_min(label, (ord * 100000000 + item, label)) AS target FROM (SELECT image_id * 3 AS image_id, ord, item, label FROM v_nbox) GROUP BY 1) t ON t.image_id = c.image_id""", EXTRA)
def j3(spark, sf):
    referring = predicted(spark, sf).select(
        (F.col("image_id") * 3).alias("image_id"), (F.col("ord") * 100000000 + F.col("item")).alias("ord"), F.col("label").alias("target"), F.lit(None).cast("string").alias("box"))
    return evaluate.caption_items(V.captions(spark, sf).select("id", "image_id"), referring).select("id", "image_id", "target")


@query("f1_normalise_answer", f"SELECT qid, {norm('prediction')} AS answer FROM v_qa", EXTRA)
def f1(spark, sf):
    return V.answers(spark, sf).select("qid", text.normalise(F.col("prediction")).alias("answer"))


@query("f2_metric_tokens", "SELECT id, len(r) AS n, md5(array_to_string(r, ' ')) AS digest FROM v_side", EXTRA)
def f2(spark, sf):
    words = text.tokens(F.col("ref"))
    return V.captions(spark, sf).select("id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query("f4_ngrams", """
    SELECT id, coalesce(n, 0) AS n, md5(coalesce(t, '')) AS digest FROM v_side LEFT JOIN (
      SELECT id, count(*) AS n, string_agg(w1 || ' ' || w2 || ' ' || w3, '|' ORDER BY pos) AS t FROM v_word WHERE side = 'r' AND w3 IS NOT NULL GROUP BY id) USING (id)""", EXTRA)
def f4(spark, sf):
    grams = V.captions(spark, sf).select("id", text.tokens(F.col("ref")).alias("w")).select("id", text.ngrams(F.col("w"), 3).alias("g"))
    return grams.select("id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|").cast("binary")).alias("digest"))


@query("f5_bleu_ref", "SELECT id, round(bleu, 6) AS bleu FROM v_bleu", EXTRA)
def f5(spark, sf):
    return evaluate.bleu_ref(V.captions(spark, sf)).select("id", six("bleu"))


@query("f5_bleu_clipped", "SELECT id, round(bleu_clipped, 6) AS bleu_clipped FROM v_bleu", EXTRA)
def f5_clipped(spark, sf):
    return evaluate.bleu_clipped(V.captions(spark, sf)).select("id", six("bleu_clipped"))


@query("f6_rouge_l")
def f6(spark, sf):
    return evaluate.rouge_l(V.captions(spark, sf)).select("id", six("rouge_l"))


def dropped(spark, sf):
    """Whole texts, and the same without every fifth token: their longest common subsequence is what is left."""
    words = text.tokens(F.col("ref"))
    fewer = F.filter(words, lambda w, i: (i + 1) % 5 != 0)
    return V.captions(spark, sf).select("id", "ref", F.array_join(fewer, " ").alias("cand"))


@query("f6_rouge_dropped", """
    SELECT id, round(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * (n - n // 5) / (n - n // 5 + n) END, 6) AS rouge_l FROM (SELECT id, len(r) AS n FROM v_side)""", EXTRA)
def f6_dropped(spark, sf):
    return evaluate.rouge_l(dropped(spark, sf)).select("id", six("rouge_l"))


@query("d4_lcs_dropped", "SELECT id, len(r) - len(r) // 5 AS lcs FROM v_side", EXTRA)
def d4_dropped(spark, sf):
    return evaluate.lcs_lengths(dropped(spark, sf))


@query("d4_lcs_kernel")
def d4(spark, sf):
    return evaluate.lcs_lengths(V.captions(spark, sf))


@query("f7_cider_proxy", "SELECT id, round(cider, 6) AS cider_proxy FROM v_cider", EXTRA)
def f7(spark, sf):
    return evaluate.cider_proxy(V.captions(spark, sf)).select("id", six("cider_proxy"))


@query("a12_caption_text_means", "SELECT count(*) AS n, round(avg(bleu), 6) AS bleu, round(avg(cider), 6) AS cider_proxy FROM v_bleu JOIN v_cider USING (id)", EXTRA)
def a12_text(spark, sf):
    return evaluate.caption_metrics(V.captions(spark, sf)).select("n", six("bleu"), six("cider_proxy"))


@query("a12_caption_metrics")
def a12(spark, sf):
    ious = boxes.first_iou(predicted(spark, sf), referring(spark, sf))
    rows = evaluate.caption_metrics(V.captions(spark, sf), ious)
    return rows.select("n", "n_iou", *[six(c) for c in ("bleu", "rouge_l", "cider_proxy", "grounding_iou")])


@query("f8_score_pairs", "SELECT qid, raw_match, norm_match, answer_match, round(bleu1, 6) AS bleu1 FROM v_answer", EXTRA)
def f8(spark, sf):
    return evaluate.score_pairs(items(spark, sf)).select("qid", "raw_match", "norm_match", "answer_match", six("bleu1"))


@query("f9_contains_answer", "SELECT qid, correct FROM v_cqa", EXTRA)
def f9(spark, sf):
    return evaluate.change_qa_scores(items(spark, sf)).select("qid", "correct")


_VQA = """
    SELECT coalesce(type, 'all') AS type, count(*) FILTER (s) AS n_scored, count(*) FILTER (NOT s) AS n_misrouted, count(*) AS n_total,
           round(count(*) FILTER (s) / count(*), 6) AS routing_fidelity, round(coalesce(avg(raw_match::INT) FILTER (s), 0), 6) AS raw_accuracy,
           round(coalesce(avg(norm_match::INT) FILTER (s), 0), 6) AS normalised_accuracy, round(coalesce(avg(answer_match::INT) FILTER (s), 0), 6) AS answer_match_rate,
           round(coalesce(avg(bleu1) FILTER (s), 0), 6) AS bleu1
    FROM (SELECT *, routed_task = 'vqa' AS s FROM v_task) GROUP BY ROLLUP (type)"""


@query("a10_vqa_metrics", _VQA, EXTRA)
def a10(spark, sf):
    rows = evaluate.vqa_metrics(routed_items(spark, sf))
    return rows.select("type", "n_scored", "n_misrouted", "n_total", *[
        six(c) for c in ("routing_fidelity", "raw_accuracy", "normalised_accuracy", "answer_match_rate", "bleu1")])


_ALL = "SELECT type, gold, correct FROM v_cqa UNION ALL SELECT 'all', gold, correct FROM v_cqa"


@query("a11_change_qa_metrics", f"""
    SELECT type, n, round(acc, 6) AS accuracy, gold AS majority_answer, round(c / n, 6) AS majority_share
    FROM (SELECT type, count(*) AS n, avg(correct::INT) AS acc FROM ({_ALL}) GROUP BY type)
    JOIN (SELECT type, gold, c FROM (SELECT type, gold, count(*) AS c, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, gold) AS r FROM ({_ALL}) GROUP BY type, gold) WHERE r = 1) USING (type)""", EXTRA)
def a11(spark, sf):
    rows = evaluate.change_qa_metrics(items(spark, sf))
    return rows.select("type", "n", six("accuracy"), "majority_answer", six("majority_share"))


@query("d5_attach_external", "SELECT qid, gold, CASE WHEN qid % 2 = 0 THEN upper(gold) END AS external FROM v_item", EXTRA)
def d5(spark, sf):
    external = V.answers(spark, sf).where("qid % 2 = 0").select("qid", F.upper("gold").alias("external"))
    return dataset.attach(items(spark, sf).select("qid", "gold"), external, ["qid"])


@query("l3_seeded_subset", """
    SELECT qid FROM v_qa ORDER BY (qid * 2654435761 + 20260831) % 4294967296, qid LIMIT 155""")
def l3(spark, sf):
    return evaluate.seeded_subset(V.answers(spark, sf), "qid", 155).select("qid")


@query("p33_text_confidence", """
    SELECT id, CASE WHEN ref IS NULL OR ref = '' THEN 0.1 WHEN regexp_matches(lower(ref), 'cannot see|can''t see|unable|i don''t know') THEN 0.3
           WHEN n < 2 THEN 0.4 WHEN n < 6 THEN 0.65 ELSE 0.85 END AS confidence
    FROM (SELECT id, ref, len(regexp_extract_all(ref, '\\S+')) AS n FROM v_cap)""", types={"confidence": "DOUBLE"})
def p33(spark, sf):
    return V.captions(spark, sf).select("id", text.text_confidence(F.col("ref")).alias("confidence"))


@query("u5_union_metrics", """
    SELECT 'vqa' AS suite, 'bleu1' AS metric, round(avg(bleu1), 6) AS value, count(*) AS n, 'measured' AS status, NULL::VARCHAR AS blocker FROM v_answer UNION ALL
    SELECT 'change', 'accuracy', round(avg(correct::INT), 6), count(*), 'measured', NULL FROM v_cqa UNION ALL
    SELECT 'fusion', 'accuracy', NULL, NULL, 'PLACEHOLDER', 'no labelled split'""", EXTRA)
def u5(spark, sf):
    return suites(spark, sf).select("suite", "metric", "value", "n", "status", "blocker")


def suites(spark, sf, date="2026-01-01"):
    a = evaluate.score_pairs(items(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bleu1"), 6).alias("bleu1"))
    b = evaluate.change_qa_scores(items(spark, sf)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    return evaluate.union_metrics(
        evaluate.metric_rows("vqa", a, date), evaluate.metric_rows("change", b, date),
        evaluate.placeholder(spark, "fusion", "accuracy", "no labelled split", date))


@query("s15_write_metrics", """
    SELECT suite, metric, value, n, status FROM (SELECT 'vqa' AS suite, 'bleu1' AS metric, round(avg(bleu1), 6) AS value, count(*) AS n, 'measured' AS status FROM v_answer UNION ALL
    SELECT 'change', 'accuracy', round(avg(correct::INT), 6), count(*), 'measured' FROM v_cqa UNION ALL SELECT 'fusion', 'accuracy', NULL, NULL, 'PLACEHOLDER')""", EXTRA)
def s15(spark, sf):
    path = scratch_path(spark, "metrics")
    files.write_metrics(suites(spark, sf), path)
    return spark.read.parquet(path).select("suite", "metric", "value", "n", "status")


@query("u6_repro_diff", """
    SELECT 'answers' AS suite, type AS metric, round(avg(bleu1), 6) AS run1, round(avg(bleu1), 6) + CASE WHEN type = 'comp' THEN 1 ELSE 0 END AS run2
    FROM v_answer GROUP BY type HAVING type = 'comp'""", EXTRA)
def u6(spark, sf):
    per = evaluate.score_pairs(items(spark, sf)).groupBy(F.col("type").alias("metric")).agg(F.round(F.avg("bleu1"), 6).alias("value"))
    first = per.select(F.lit("answers").alias("suite"), "metric", "value", F.lit("2026-01-01").alias("date"))
    second = first.withColumns({"date": F.lit("2026-01-02"), "value": F.col("value") + F.when(F.col("metric") == "comp", 1.0).otherwise(0.0)})
    rows = evaluate.repro_diff(first, second)
    return rows.select("suite", "metric", F.col("run1.value").alias("run1"), F.col("run2.value").alias("run2"))


@query("p23_norm_boxes", """
    SELECT image_id, ord, item, label, confidence, round(ymin, 4) AS ymin, round(xmin, 4) AS xmin, round(ymax, 4) AS ymax, round(xmax, 4) AS xmax FROM v_nbox""", EXTRA)
def p23(spark, sf):
    rows = predicted(spark, sf)
    return rows.select("image_id", "ord", "item", "label", "confidence", *[F.round(c, 4).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")])


@query("p24_parse_ref_box", """
    SELECT image_id, ord, item, CASE WHEN ok THEN round(rymin, 4) END AS ymin, CASE WHEN ok THEN round(rxmin, 4) END AS xmin, CASE WHEN ok THEN round(rymax, 4) END AS ymax, CASE WHEN ok THEN round(rxmax, 4) END AS xmax FROM v_ref""", EXTRA)
def p24(spark, sf):
    box = boxes.parse_ref_box(F.col("raw"), F.col("w"), F.col("h"))
    rows = V.boxes(spark, sf).select("image_id", "ord", "item", box.alias("b"))
    return rows.select("image_id", "ord", "item", *[F.round(f"b.{c}", 4).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")])


@query("j19_box_iou", "SELECT image_id, ord, item, round(iou, 6) AS iou FROM v_iou", EXTRA)
def j19(spark, sf):
    return boxes.box_iou(predicted(spark, sf), reference(spark, sf)).select("image_id", "ord", "item", six("iou"))


@query("j19_overlapping_boxes", """
    SELECT image_id, ord_a, item_a, ord_b, item_b, round(i / (area_a + area_b - i), 6) AS iou FROM (
      SELECT a.image_id, a.ord AS ord_a, a.item AS item_a, b.ord AS ord_b, b.item AS item_b,
             (a.xmax - a.xmin) * (a.ymax - a.ymin) AS area_a, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS area_b,
             (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS i
      FROM v_nbox a JOIN v_nbox b ON a.image_id = b.image_id AND (a.ord, a.item) < (b.ord, b.item)
        AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)""", EXTRA)
def j19_overlapping(spark, sf):
    rows = boxes.overlapping_boxes(predicted(spark, sf))
    return rows.select("image_id", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("ord", "item")], six("iou"))


@query("j19_first_iou", """
    SELECT image_id, round(CASE WHEN u > 0 THEN i / u ELSE 0.0 END, 6) AS iou FROM (
      SELECT *, (ymax - ymin) * (xmax - xmin) + (rymax - rymin) * (rxmax - rxmin) - i AS u FROM (
        SELECT *, greatest(0.0, least(xmax, rxmax) - greatest(xmin, rxmin)) * greatest(0.0, least(ymax, rymax) - greatest(ymin, rymin)) AS i
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord, item, label, confidence, ymin, xmin, ymax, xmax) AS k FROM v_nbox) JOIN (
          SELECT * EXCLUDE (ord, item), row_number() OVER (PARTITION BY image_id ORDER BY ord, item, ok, rymin, rxmin, rymax, rxmax) AS k2 FROM v_ref) USING (image_id)
        WHERE k = 1 AND k2 = 1 AND ok))""", EXTRA)
def j19_first(spark, sf):
    return boxes.first_iou(predicted(spark, sf), referring(spark, sf)).select("image_id", six("iou"))


@query("l2_best_box", "SELECT image_id, n, confidence, label, round(ymin, 4) AS ymin FROM v_bestbox", EXTRA)
def l2(spark, sf):
    return boxes.best_box(predicted(spark, sf)).select("image_id", "n", "confidence", "label", F.round("box.ymin", 4).alias("ymin"))


@query("l2_first_box", """
    SELECT image_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord, item, label, confidence) AS r FROM v_nbox) WHERE r = 1""", EXTRA)
def l2_first(spark, sf):
    return boxes.first_box(predicted(spark, sf)).select("image_id", "label", "confidence")


@query("p30_grounding_text", """
    SELECT image_id, 'Detected ' || n || ' instance(s) of ''ship''. Highest-confidence detection scores ' || printf('%.2f', confidence) || '.' AS text FROM v_bestbox""", EXTRA)
def p30_grounding(spark, sf):
    best = boxes.best_box(predicted(spark, sf))
    return best.select("image_id", grounding_text(F.col("n"), F.lit("ship"), F.col("confidence")).alias("text"))


@query("f18_ring", """
    SELECT image_id, ord, item, x1 || ' ' || y1 || ',' || x2 || ' ' || y1 || ',' || x2 || ' ' || y2 || ',' || x1 || ' ' || y2 || ',' || x1 || ' ' || y1 AS ring
    FROM (SELECT image_id, ord, item, floor(xmin)::INT AS x1, floor(ymin)::INT AS y1, floor(xmax)::INT AS x2, floor(ymax)::INT AS y2 FROM v_nbox)""", EXTRA)
def f18(spark, sf):
    at = lambda c: F.floor(c).cast("int")
    rows = predicted(spark, sf).select("image_id", "ord", "item", ring(at("xmin"), at("ymin"), at("xmax"), at("ymax")).alias("r"))
    return rows.select("image_id", "ord", "item", F.array_join(F.transform("r", lambda p: F.array_join(p.cast("array<string>"), " ")), ",").alias("ring"))


@query("s14_to_geojson", """
    SELECT '{"type":"Feature","properties":{"label":"Detected Region"},"geometry":{"type":"Polygon","coordinates":[[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y1 || '],['
      || x2 || ',' || y2 || '],[' || x1 || ',' || y2 || '],[' || x1 || ',' || y1 || ']]]}}' AS feature
    FROM (SELECT floor(xmin)::INT AS x1, floor(ymin)::INT AS y1, floor(xmax)::INT AS x2, floor(ymax)::INT AS y2 FROM v_nbox)""", EXTRA)
def s14(spark, sf):
    at = lambda c: F.floor(c).cast("int")
    path = scratch_path(spark, "features")
    boxes.write_geojson(predicted(spark, sf).select(boxes.to_geojson(at("xmin"), at("ymin"), at("xmax"), at("ymax")).alias("feature")), path)
    return spark.read.text(path).select(F.col("value").alias("feature"))
