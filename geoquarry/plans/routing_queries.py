"""Query routing queries."""

from pyspark.sql import functions as F

from geoquarry.operators import lookup, routing, rules
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.scene_queries import six
from geoquarry.plans.sql import quote, sql_list

_FIRST = "CASE " + " ".join(
    f"WHEN regexp_matches(query, {quote(p)}, 'i') THEN {i}" for i, (_, _, p) in enumerate(rules.RULES)) + " END"
_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(query, {quote(p)}, 'i') THEN {i} END" for i, (_, _, p) in enumerate(rules.RULES)) + "], lambda i: i IS NOT NULL)"
_R_TASK = sql_list([t for t, _, _ in rules.RULES])
_R_NAME = sql_list([n for _, n, _ in rules.RULES])
_STOP = sql_list(sorted(set(rules.STOP_WORDS)))


def _token_list(text):
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: len(w) > 1 AND NOT list_contains({_STOP}, w))"


_REFERENCE = "CASE " + " ".join(f"WHEN regexp_matches(query, {quote(p)}, 'i') THEN {quote(n)}" for n, p in rules.REFERENCES) + " ELSE 'unspecified' END"
_SUB = lambda text, p, to: f"regexp_replace({text}, {quote(p)}, {quote(to)}, 'i')"
_TARGET = "query"
for _p, _to in ((rules.TARGET_LEAD, " "), (rules.TARGET_WHERE, ""), (rules.TARGET_TRAIL, "")):
    _TARGET = _SUB(_TARGET, _p, _to)
_TARGET = _SUB(f"trim({_TARGET}, ' .?!' || chr(9) || chr(10))", rules.TARGET_ARTICLE, "")

EXTRA = {
    "v_text_hits": f"SELECT query, {_HITS} AS hits FROM (SELECT DISTINCT query FROM v_query)",
    "v_example": "SELECT unnest(" + sql_list([x for _, x in routing.EXAMPLES]) + ") AS text, unnest(" + sql_list(
        [t for t, _ in routing.EXAMPLES]) + ") AS task, unnest(range(0, " + str(len(routing.EXAMPLES)) + ")) AS example",
    "v_ex_token": f"SELECT example, task, text, unnest({_token_list('text')}) AS token FROM v_example",
    "v_ex_idf": "SELECT token, ln((1.0 + (SELECT count(*) FROM v_example)) / (1.0 + count(DISTINCT example))) + 1.0 AS w FROM v_ex_token GROUP BY token",
    "v_ex_norm": "SELECT example, sqrt(sum(w * w)) AS n FROM v_ex_token JOIN v_ex_idf USING (token) GROUP BY example",
    "v_q_token": f"SELECT query, token, count(*) AS tf FROM (SELECT query, unnest({_token_list('query')}) AS token FROM (SELECT DISTINCT query FROM v_query)) GROUP BY ALL",
    "v_q_norm": "SELECT query, sqrt(sum((tf * w) * (tf * w))) AS n FROM v_q_token JOIN v_ex_idf USING (token) GROUP BY query",
    "v_ex_score": """
        SELECT query, e.example, any_value(e.task) AS task, any_value(e.text) AS text, sum(tf * w * w) / (any_value(q.n) * any_value(x.n)) AS score
        FROM v_q_token JOIN v_ex_idf USING (token) JOIN v_ex_token e USING (token) JOIN v_q_norm q USING (query) JOIN v_ex_norm x ON x.example = e.example
        GROUP BY query, e.example""",
    "v_best": f"""
        SELECT query, task, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, list_position({sql_list(rules.TASKS)}, task)) - 1 AS rank
        FROM (SELECT q.query, t.task, coalesce(max(s.score), 0.0) AS score FROM v_q_norm q, (SELECT unnest({sql_list(rules.TASKS)}) AS task) t
              LEFT JOIN v_ex_score s ON s.query = q.query AND s.task = t.task GROUP BY ALL)""",
    "v_alt": "SELECT query, string_agg(task || '(score=' || printf('%.3f', score) || ')', ' | ' ORDER BY rank) AS alt FROM v_best WHERE rank BETWEEN 1 AND 3 GROUP BY query",
    "v_decision": f"""
        SELECT h.query, CASE WHEN len(hits) > 0 THEN ({_R_TASK})[hits[1] + 1] WHEN b.score >= 0.22 THEN b.task ELSE 'vqa' END AS task,
               CASE WHEN len(hits) > 0 THEN 'rule' ELSE 'exemplar_nn' END AS mechanism,
               CASE WHEN len(hits) > 0 THEN ({_R_NAME})[hits[1] + 1] WHEN b.score >= 0.22 THEN 'exemplar:' || b.task ELSE 'default:vqa_fallback' END AS matched,
               CASE WHEN len(hits) > 0 THEN 1.0 WHEN b.score >= 0.22 THEN b.score ELSE 0.0 END AS score,
               CASE WHEN len(hits) > 0 THEN array_to_string(list_transform(list_filter(hits, lambda i: ({_R_TASK})[i + 1] <> ({_R_TASK})[hits[1] + 1]
                      AND NOT (i = 15 AND list_contains(hits, 14))), lambda i: ({_R_TASK})[i + 1] || ' (' || ({_R_NAME})[i + 1] || ')'), ' | ')
                    ELSE coalesce(alt, '') END AS alternatives,
               {_REFERENCE.replace('query', 'h.query')} AS reference
        FROM v_text_hits h LEFT JOIN (SELECT * FROM v_best WHERE rank = 0) b ON b.query = h.query LEFT JOIN v_alt a ON a.query = h.query""",
    "v_routed": """
        SELECT qid, ts, user_id, query, n_inputs, gold_task, task, mechanism, matched, score, alternatives, reference,
               CASE WHEN reference = 'second' AND n_inputs >= 2 THEN 1 ELSE 0 END AS image_index FROM v_query JOIN v_decision USING (query)""",
}
_NOTE = """'routing via ' || mechanism || ' (' || matched || '); ' || CASE
    WHEN task IN ('vqa', 'caption', 'grounding') AND n_inputs >= 2 THEN 'single-image task ''' || task || ''' selected from query text despite ' || n_inputs
      || ' inputs; default single-image task runs on ' || CASE WHEN reference = 'second' THEN 'image ' || (image_index + 1) ELSE 'image 1' END
      || CASE WHEN reference = 'both' THEN '; query refers to ''both images''; controller runs single-image analyses one image at a time and defaults to image 1' ELSE '' END
    WHEN task IN ('vqa', 'caption', 'grounding') AND reference = 'second' THEN 'query references a second image but only 1 was supplied; using image 1'
    WHEN task IN ('vqa', 'caption', 'grounding') THEN 'single-image task ''' || task || ''' runs on the one supplied image'
    WHEN n_inputs < 2 THEN 'task ''' || task || ''' needs 2 images but ' || n_inputs || ' were supplied — validation will refuse this run; routing is query-driven by design (R4)'
    ELSE 'task ''' || task || ''' accepts the ' || n_inputs || ' supplied images' END"""


@query("f3_router_tokens", f"SELECT qid, array_to_string({_token_list('query')}, ' ') AS tokens FROM v_query", EXTRA)
def f3(spark, sf):
    return V.queries(spark, sf).select("qid", F.array_join(routing.router_tokens(F.col("query")), " ").alias("tokens"))


@query("j16_rule_hits", f"SELECT qid, i AS ordinal, ({_R_TASK})[i + 1] AS task, ({_R_NAME})[i + 1] AS name FROM (SELECT qid, unnest(hits) AS i FROM v_query JOIN v_text_hits USING (query))", EXTRA)
def j16(spark, sf):
    return routing.rule_matches(V.queries(spark, sf))


@query("j16_rule_table", f"SELECT qid, i AS ordinal, ({_R_TASK})[i + 1] AS task, ({_R_NAME})[i + 1] AS name FROM (SELECT qid, unnest(hits) AS i FROM v_query JOIN v_text_hits USING (query))", EXTRA)
def j16_table(spark, sf):
    return lookup.rule_matches(V.queries(spark, sf), V.rule_table(spark))


#: Examples from parts instead of the fixed ones, and queries of their words.
PART_VIEWS = {
    "v_part_query": """
        SELECT a.p_partkey AS qid, 'show the ' || a.p_name || ' ' || a.p_name || ' of' || coalesce(' ' || b.p_type || ' size' || b.p_size, '') AS query
        FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1""",
    "v_part_text": "SELECT DISTINCT query FROM v_part_query",
    "v_pe": f"SELECT p_partkey AS example, ({sql_list(rules.TASKS)})[p_partkey % {len(rules.TASKS)} + 1] AS task, p_name || ' ' || p_type || ' ' || p_brand || ' size' || p_size AS text FROM part",
    "v_pe_token": f"SELECT example, task, token, count(*) AS tf FROM (SELECT example, task, unnest({_token_list('text')}) AS token FROM v_pe) GROUP BY ALL",
    "v_pe_idf": "SELECT token, ln((1.0 + (SELECT count(*) FROM v_pe)) / (1.0 + count(*))) + 1.0 AS w FROM v_pe_token GROUP BY token",
    "v_pe_norm": "SELECT example, sqrt(sum(tf * w * w)) AS n FROM v_pe_token JOIN v_pe_idf USING (token) GROUP BY example",
    "v_pq_token": f"SELECT query, token, count(*) AS tf FROM (SELECT query, unnest({_token_list('query')}) AS token FROM v_part_text) GROUP BY ALL",
    "v_pq_norm": "SELECT query, sqrt(sum((tf * w) * (tf * w))) AS n FROM v_pq_token JOIN v_pe_idf USING (token) GROUP BY query",
    "v_pe_score": """
        SELECT query, task, max(s) AS score FROM (
          SELECT q.query, e.example, any_value(e.task) AS task, sum(q.tf * w * w * e.tf) / (any_value(n.n) * any_value(x.n)) AS s
          FROM v_pq_token q JOIN v_pe_idf USING (token) JOIN v_pe_token e USING (token) JOIN v_pq_norm n USING (query) JOIN v_pe_norm x ON x.example = e.example
          GROUP BY q.query, e.example) GROUP BY query, task""",
}


@query("w7_best_of_table", f"""
    SELECT qid, t.task, round(coalesce(score, 0.0), 6) AS score FROM v_part_query q CROSS JOIN (SELECT unnest({sql_list(rules.TASKS)}) AS task) t
    LEFT JOIN v_pe_score s ON s.query = q.query AND s.task = t.task""", PART_VIEWS)
def w7_table(spark, sf):
    rows = lookup.best_examples(V.part_queries(spark, sf), V.exemplars(spark, sf), rules.TASKS)
    return rows.withColumn("score", F.round("score", 6))


@query("w6_first_rule", f"SELECT qid, i AS ordinal, ({_R_TASK})[i + 1] AS task, ({_R_NAME})[i + 1] AS name FROM (SELECT qid, {_FIRST} AS i FROM v_query)")
def w6(spark, sf):
    return routing.first_rule(V.queries(spark, sf))


@query("j15_exemplar_scores", "SELECT qid, example, task, text, round(score, 6) AS score FROM v_query JOIN v_ex_score USING (query)", EXTRA)
def j15(spark, sf):
    return routing.exemplar_matches(V.queries(spark, sf)).select("qid", "example", "task", "text", six("score"))


@query("w7_best_tasks", "SELECT qid, rank, task, round(score, 6) + 0.0 AS score FROM v_query JOIN v_best USING (query)", EXTRA)
def w7(spark, sf):
    return routing.best_tasks(V.queries(spark, sf)).select("qid", "rank", "task", six("score"))


@query("f10_route", "SELECT qid, task, mechanism, matched, round(score, 6) AS score, alternatives, reference FROM v_routed", EXTRA)
def f10(spark, sf):
    return routing.route(V.queries(spark, sf)).select(
        "qid", "task", "mechanism", "matched", six("score"), F.array_join("alternatives", " | ").alias("alternatives"), "reference")


@query("f11_image_reference", """
    SELECT qid, reference, image_index, CASE WHEN reference = 'second' AND n_inputs >= 2 THEN 'second-or-later image'
           WHEN reference = 'second' THEN 'second image referenced but only one supplied; using image 1' ELSE 'first image' END AS image_note FROM v_routed""", EXTRA)
def f11(spark, sf):
    return routing.route(V.queries(spark, sf)).select("qid", "reference", "image_index", "image_note")


@query("f12_resolution_note", f"SELECT qid, {_NOTE} AS note FROM v_routed", EXTRA)
def f12(spark, sf):
    return routing.route(V.queries(spark, sf)).select("qid", "note")


@query("f13_grounding_target", f"SELECT qid, CASE WHEN len(t) > 1 THEN t ELSE trim(query, ' .?!') END AS target FROM (SELECT qid, query, {_TARGET} AS t FROM v_query)")
def f13(spark, sf):
    return V.queries(spark, sf).select("qid", routing.grounding_target(F.col("query")).alias("target"))


@query("a22_idf", f"""
    SELECT token, count(*) AS df, round(ln((1.0 + (SELECT count(DISTINCT query) FROM v_query)) / (1.0 + count(*))) + 1.0, 6) AS idf
    FROM (SELECT DISTINCT query, unnest({_token_list('query')}) AS token FROM v_query) GROUP BY token""", EXTRA)
def a22(spark, sf):
    return routing.idf(V.queries(spark, sf)).select("token", "df", six("idf"))


@query("a8_routing_accuracy", """
    SELECT coalesce(gold_task, 'all') AS gold_task, count(*) AS n, sum((task = gold_task)::INT) AS correct, round(avg((task = gold_task)::INT), 6) AS accuracy
    FROM v_routed GROUP BY ROLLUP (gold_task)""", EXTRA, types={"correct": "BIGINT"})
def a8(spark, sf):
    return routing.routing_accuracy(routing.route(V.queries(spark, sf))).select("gold_task", "n", "correct", six("accuracy"))


@query("a9_confusion_matrix", "SELECT g AS gold_task, " + ", ".join(f"count(*) FILTER (task = '{t}') AS {t}" for t in rules.TASKS) + f"""
    FROM (SELECT unnest({sql_list(rules.TASKS)}) AS g) LEFT JOIN v_routed ON gold_task = g GROUP BY g""", EXTRA)
def a9(spark, sf):
    return routing.confusion_matrix(routing.route(V.queries(spark, sf)))
