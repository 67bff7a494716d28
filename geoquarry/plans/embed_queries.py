"""Embedding queries."""

from pyspark.sql import functions as F

from geoquarry.functions.vectors import cosine, dot, norm, unit
from geoquarry.operators import embed, evaluate, trace
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import six
from geoquarry.plans.sql import quote

_DOT = "list_dot_product"


def _rank_sql(sim):
    return f"""
        SELECT a.id, o.s AS own, CASE WHEN o.s IS NOT NULL THEN 1 + sum((a.other <> a.id AND (a.s > o.s OR (a.s = o.s AND a.other < a.id)))::INT) END AS rank, count(*) AS n,
               max(a.s) AS best_score, min(a.other) FILTER (a.s = m.s) AS best
        FROM {sim} a LEFT JOIN {sim} o ON o.id = a.id AND o.other = a.id JOIN (SELECT id, max(s) AS s FROM {sim} GROUP BY id) m ON m.id = a.id
        GROUP BY a.id, o.s"""


EXTRA = {
    "v_top": """
        SELECT vec_id, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, name) AS rank FROM v_score) WHERE rank <= 5""",
    "v_sim": f"""
        SELECT i.vec_id AS id, t.vec_id AS other, round({_DOT}(i.e, t.t) / (sqrt({_DOT}(i.e, i.e)) * sqrt({_DOT}(t.t, t.t))), 9) AS s FROM v_emb i, v_text t""",
    "v_rank": _rank_sql("v_sim"),
    "v_sim_half": f"""
        SELECT i.vec_id AS id, t.vec_id AS other, round({_DOT}(i.e[1:16], t.t[1:16]) / (sqrt({_DOT}(i.e[1:16], i.e[1:16])) * sqrt({_DOT}(t.t[1:16], t.t[1:16]))), 9) AS s FROM v_emb i, v_text t""",
    "v_rank_half": _rank_sql("v_sim_half"),
    "v_points": """
        SELECT cls, s AS score, sum(hit) AS hit, sum(count(*)) OVER w AS run_one, sum(sum(hit)) OVER w AS run_hit
        FROM (SELECT cls, round(score, 9) AS s, list_contains(labels, cls)::INT AS hit FROM v_score WHERE split = 'test')
        GROUP BY cls, s WINDOW w AS (PARTITION BY cls ORDER BY s DESC)""",
    "v_ap": """
        SELECT cls, sum(run_hit / run_one * hit) / sum(hit) AS ap FROM v_points GROUP BY cls""",
    "v_f1": """
        SELECT cls, sum(y) AS positives, CASE WHEN 2 * sum(p * y) + sum(p * (1 - y)) + sum((1 - p) * y) = 0 THEN 0.0
               ELSE 2.0 * sum(p * y) / (2 * sum(p * y) + sum(p * (1 - y)) + sum((1 - p) * y)) END AS f1
        FROM (SELECT cls, (round(score, 9) > 0)::INT AS p, list_contains(labels, cls)::INT AS y FROM v_score WHERE split = 'test') GROUP BY cls""",
    "v_pairs": """
        SELECT a.vec_id AS pair, a.name AS label, a.score AS raw_t0, coalesce(b.score, 0.0) AS raw_t1
        FROM v_score a LEFT JOIN v_score b ON b.vec_id = a.vec_id + 1 AND b.name = a.name""",
    "v_delta": """
        SELECT pair, label, raw_t0, raw_t1, p0, p1, p1 - p0 AS delta,
               row_number() OVER (PARTITION BY pair ORDER BY round(abs(p1 - p0), 9) DESC, label) AS rank
        FROM (SELECT *, exp(raw_t0 - max(raw_t0) OVER w) / sum(exp(raw_t0)) OVER w * exp(max(raw_t0) OVER w) * 100 AS p0,
                     exp(raw_t1 - max(raw_t1) OVER w) / sum(exp(raw_t1)) OVER w * exp(max(raw_t1) OVER w) * 100 AS p1
              FROM v_pairs WINDOW w AS (PARTITION BY pair))""",
    "v_agree": """
        SELECT vec_id, list_sort(list_intersect(o, r)) AS a, list_sort(list_filter(o, lambda x: NOT list_contains(r, x))) AS oo,
               list_sort(list_filter(r, lambda x: NOT list_contains(o, x))) AS ro, len(list_distinct(list_concat(o, r))) AS u
        FROM (SELECT x.vec_id, x.names AS o, coalesce(y.names, []) AS r FROM (SELECT vec_id, list(name) AS names FROM v_top GROUP BY 1) x
              LEFT JOIN (SELECT vec_id - 1 AS vec_id, list(name) AS names FROM v_top GROUP BY 1) y USING (vec_id))""",
}


def scores(spark, sf):
    return embed.label_scores(V.embeddings(spark, sf), V.class_vectors(spark, sf))


def top(spark, sf):
    return embed.best_labels(V.embeddings(spark, sf), V.class_vectors(spark, sf))


def judged(spark, sf):
    """Test-split class scores with their truth."""
    held = V.embeddings(spark, sf).where("split = 'test'")
    rows = embed.label_scores(held, V.class_vectors(spark, sf)).join(held.select("vec_id", "labels"), "vec_id")
    cls = F.regexp_extract("label", "_([0-9]+)$", 1).cast("int")
    return rows.select(
        "vec_id", cls.alias("cls"), F.round("score", 9).alias("score"), F.array_contains("labels", cls).cast("int").alias("truth"))


def two_dates(spark, sf):
    # each vector is scored once, as the first date of its pair and the second of the one before
    roles = F.array(*[F.struct((F.col("vec_id") - d).alias("pair"), F.lit(d).alias("date")) for d in (0, 1)])
    rows = scores(spark, sf).select(F.explode(roles).alias("r"), "label", "score").select("r.*", "label", "score")
    return embed.dated_delta(rows.where("pair >= 0"))


def ranks(spark, sf, encoder=lambda v: v):
    images = V.embeddings(spark, sf).select(F.col("vec_id").alias("id"), encoder(F.col("e")).alias("v"))
    texts = V.text_vectors(spark, sf).select(F.col("vec_id").alias("id"), encoder(F.col("t")).alias("v"))
    return embed.pair_scores(images, texts)


@query("p14_l2_normalise", f"""
    SELECT vec_id, round({_DOT}(u, u), 6) AS length, round(u[1], 6) + 0.0 AS first, round(list_sum(u), 5) + 0.0 AS total
    FROM (SELECT vec_id, list_transform(e, lambda v: v / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT *, sqrt({_DOT}(e, e)) AS n FROM v_emb))""")
def p14(spark, sf):
    u = V.embeddings(spark, sf).select("vec_id", unit(F.col("e")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, v: s + v)
    return u.select("vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("length"),
                    (F.round(F.col("u")[0], 6) + 0.0).alias("first"), (F.round(total, 5) + 0.0).alias("total"))


@query("f24_vector_math", f"""
    SELECT a.vec_id, round({_DOT}(e, t), 6) + 0.0 AS dot, round({_DOT}(e, t) / (sqrt({_DOT}(e, e)) * sqrt({_DOT}(t, t))), 6) + 0.0 AS cosine, round(sqrt({_DOT}(e, e)), 6) AS norm
    FROM v_emb a JOIN v_text b USING (vec_id)""")
def f24(spark, sf):
    rows = V.embeddings(spark, sf).join(V.text_vectors(spark, sf), "vec_id")
    e, t = F.col("e"), F.col("t")
    return rows.select("vec_id", (F.round(dot(e, t), 6) + 0.0).alias("dot"), (F.round(cosine(e, t), 6) + 0.0).alias("cosine"),
                       F.round(norm(e), 6).alias("norm"))


@query("j17_label_scores", "SELECT vec_id, name AS label, round(score, 6) + 0.0 AS score FROM v_score")
def j17(spark, sf):
    return scores(spark, sf).select("vec_id", "label", six("score"))


@query("w2_top_labels", "SELECT vec_id, name AS label, rank, round(score, 6) + 0.0 AS score FROM v_top", EXTRA)
def w2(spark, sf):
    return top(spark, sf).select("vec_id", "label", "rank", six("score"))


@query("j18_pair_scores", "SELECT id, round(own, 6) + 0.0 AS own, rank, n, best, round(best_score, 6) + 0.0 AS best_score FROM v_rank", EXTRA, types={"rank": "BIGINT"})
def j18(spark, sf):
    return ranks(spark, sf).select("id", six("own"), "rank", "n", "best", six("best_score"))


@query("w5_true_pair_rank", "SELECT id, rank FROM v_rank", EXTRA, types={"rank": "BIGINT"})
def w5(spark, sf):
    return ranks(spark, sf).select("id", "rank")


@query("d2_block_similarity", "SELECT id, rank FROM v_rank", EXTRA, types={"rank": "BIGINT"})
def d2(spark, sf):
    images = V.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("e").alias("v"))
    texts = V.text_vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("t").alias("v"))
    return embed.pair_scores(images, texts, tile=200).select("id", "rank")


@query("a13_recall_at_k", """
    SELECT count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS r1, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS r5 FROM v_rank""", EXTRA)
def a13(spark, sf):
    return embed.recall_at_k(ranks(spark, sf)).select("n", six("r1"), six("r5"))


@query("w10_precision_points", """
    SELECT cls, round(score, 9) AS score, run_hit::BIGINT AS run_hit, run_one::BIGINT AS run_one, round(run_hit / run_one, 6) AS precision FROM v_points""", EXTRA)
def w10(spark, sf):
    return embed.precision_points(judged(spark, sf)).select("cls", "score", "run_hit", "run_one", six("precision"))


@query("a14_multilabel_metrics", "SELECT cls, positives::BIGINT AS positives, round(ap, 6) AS ap, round(f1, 6) AS f1 FROM v_ap JOIN v_f1 USING (cls)", EXTRA)
def a14(spark, sf):
    return embed.multilabel_metrics(judged(spark, sf)).select("cls", "positives", six("ap"), six("f1"))


@query("a14_macro", "SELECT round(avg(ap), 6) AS map, round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM v_ap JOIN v_f1 USING (cls)", EXTRA)
def a14_macro(spark, sf):
    return embed.macro(embed.multilabel_metrics(judged(spark, sf))).select(six("map"), six("macro_f1"), "classes")


@query("a15_linear_probe")
def a15(spark, sf):
    rows = V.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "e", "labels", "split")
    probe = embed.linear_probe(rows.where("split = 'train'"), rows.where("split = 'test'"), list(range(10)))
    return embed.multilabel_metrics(probe).select("cls", "positives", six("ap"), six("f1"))


@query("a16_label_matrix", "SELECT vec_id, " + ", ".join(f"list_contains(labels, {c})::INT AS is_{c}" for c in range(10)) + " FROM v_emb")
def a16(spark, sf):
    return embed.label_matrix(V.embeddings(spark, sf), range(10)).select("vec_id", *[f"is_{c}" for c in range(10)])


@query("j8_class_delta_join", "SELECT pair, label, round(raw_t0, 6) + 0.0 AS raw_t0, round(raw_t1, 6) + 0.0 AS raw_t1 FROM v_pairs", EXTRA)
def j8(spark, sf):
    return two_dates(spark, sf).select("pair", "label", six("raw_t0"), six("raw_t1"))


@query("w9_softmax_delta", "SELECT pair, label, round(p0, 5) AS pct_t0, round(p1, 5) AS pct_t1, round(delta, 5) + 0.0 AS delta_pct FROM v_delta", EXTRA)
def w9(spark, sf):
    rows = embed.softmax_delta(two_dates(spark, sf))
    return rows.select("pair", "label", *[(F.round(c, 5) + 0.0).alias(c) for c in ("pct_t0", "pct_t1", "delta_pct")])


@query("l1_movers", "SELECT pair, label, rank, round(delta, 5) + 0.0 AS delta_pct FROM v_delta WHERE rank <= 3", EXTRA)
def l1(spark, sf):
    rows = embed.movers(embed.softmax_delta(two_dates(spark, sf)), k=3)
    return rows.select("pair", "label", "rank", (F.round("delta_pct", 5) + 0.0).alias("delta_pct"))


@query("l1_mover_text", """
    SELECT pair, string_agg(label || ' ' || CASE WHEN round(delta, 1) < 0 THEN '' ELSE '+' END || printf('%.1f', CASE WHEN round(delta, 1) = 0 THEN 0.0 ELSE delta END) || 'pp', ', ' ORDER BY rank) AS movers
    FROM v_delta WHERE rank <= 3 GROUP BY pair""", EXTRA)
def l1_text(spark, sf):
    return embed.mover_text(embed.softmax_delta(two_dates(spark, sf)))


@query("u1_agreement", """
    SELECT vec_id, array_to_string(a, ',') AS agreement, array_to_string(oo, ',') AS optical_only, array_to_string(ro, ',') AS sar_only,
           round_even(len(a) / greatest(u, 1) * 100, 1) AS agreement_pct, round_even(100 - len(a) / greatest(u, 1) * 100, 1) AS disagreement_pct FROM v_agree""", EXTRA)
def u1(spark, sf):
    best = top(spark, sf)
    radar = best.select((F.col("vec_id") - 1).alias("vec_id"), "label").where("vec_id >= 0")
    rows = embed.agreement(best.select("vec_id", "label"), radar)
    return rows.select("vec_id", *[F.array_join(c, ",").alias(c) for c in ("agreement", "optical_only", "sar_only")],
                       "agreement_pct", "disagreement_pct")


@query("a24_before_after", """
    SELECT metric, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) + 0.0 AS delta FROM (
      SELECT 'r1' AS metric, (SELECT avg(coalesce((rank <= 1)::INT, 0)) FROM v_rank) AS a, (SELECT avg(coalesce((rank <= 1)::INT, 0)) FROM v_rank_half) AS b UNION ALL
      SELECT 'r5', (SELECT avg(coalesce((rank <= 5)::INT, 0)) FROM v_rank), (SELECT avg(coalesce((rank <= 5)::INT, 0)) FROM v_rank_half))""", EXTRA)
def a24(spark, sf):
    # the earlier encoder keeps the first sixteen numbers of a vector
    short = ranks(spark, sf, lambda v: F.slice(v, 1, 16))
    side = lambda name, r: evaluate.metric_rows(name, embed.recall_at_k(r), "2026-01-01").select(
        F.lit(name).alias("encoder"), "metric", "value")
    rows = embed.before_after(side("before", short).unionByName(side("after", ranks(spark, sf))))
    return rows.select("metric", six("before"), six("after"), six("delta"))


@query("p34_prompt_table", f"""
    SELECT q.vec_id, 'How many ships?' AS query,
      {quote(trace.SYSTEM_PROMPT)} || ev || {quote(trace.VQA_ASK)} || 'How many ships?' || chr(10) || 'Answer:' AS vqa_prompt,
      {quote(trace.SYSTEM_PROMPT)} || ev || {quote(trace.CAPTION_ASK)} AS caption_prompt,
      CASE WHEN q.label = 0 THEN 'object.' WHEN q.label = 1 THEN 'river.' ELSE 'ship ' || q.label || '.' END AS detector_prompt
    FROM v_emb q JOIN (SELECT vec_id, {quote(trace.EVIDENCE_LEAD)} || string_agg(name || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY rank) || '.' AS ev FROM v_top GROUP BY vec_id) USING (vec_id)""", EXTRA)
def p34(spark, sf):
    rows = V.embeddings(spark, sf)
    target = F.when(F.col("label") == 0, " ").when(F.col("label") == 1, " River.").otherwise(F.concat(F.lit("Ship "), F.col("label").cast("string")))
    requests = rows.select("vec_id", F.lit("How many ships?").alias("query"), target.alias("target"))
    return trace.prompt_table(requests, top(spark, sf))


@query("d1_user_encoder", """
    SELECT vec_id, round(list_sum(v), 5) + 0.0 AS total, round(v[1], 6) + 0.0 AS first, round(v[32], 6) + 0.0 AS last, len(v) AS size
    FROM (SELECT vec_id, list_transform(range(1, 33), lambda i: e[i] * 0.75 - e[i + 32] * 0.25) AS v FROM v_emb)""")
def d1(spark, sf):
    def load():
        # an encoder that halves its input: a fixed linear map, made once per task
        import numpy as np

        weights = np.vstack([np.eye(32) * 0.75, np.eye(32) * -0.25])
        return lambda values: np.array([list(v) for v in values], dtype=float) @ weights

    out = embed.encode(V.embeddings(spark, sf).select("vec_id", F.col("e").alias("raw")), load, "raw")
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", (F.round(total, 5) + 0.0).alias("total"), (F.round(F.col("e")[0], 6) + 0.0).alias("first"),
                      (F.round(F.col("e")[31], 6) + 0.0).alias("last"), F.size("e").alias("size"))
