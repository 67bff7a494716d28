"""Trace, contract and streaming queries."""

import datetime

from pyspark.sql import functions as F

from geoquarry.operators import catalog, routing, trace
from geoquarry.operators.change import fusion_text
from geoquarry.plans import views as V
from geoquarry.plans.registry import query
from geoquarry.plans.routing_queries import EXTRA as ROUTING_VIEWS
from geoquarry.plans.scene_queries import EXTRA as SCENE_VIEWS, guarded, six
from geoquarry.plans.sql import quote, sql_list
from geoquarry.plans.templates import TRACES
from geoquarry.session import scratch_path
from geoquarry.streaming import jobs


def _type_sql(j, kind):
    """Condition under which a JSON value breaks its kind, in SQL."""
    t = f"json_type({j})"
    text = f"({j} ->> '$')"
    number = f"{t} IN ('DOUBLE', 'BIGINT', 'UBIGINT')"
    if isinstance(kind, list):
        return f"CASE WHEN {t} <> 'VARCHAR' OR {text} NOT IN ({', '.join(map(quote, kind))}) THEN 'not in domain' END"
    items = f"json_extract({j}, '$[*]')"
    at = lambda i: f"({j} ->> '$[{i}]')::DOUBLE"
    tests = {
        "str": f"{t} <> 'VARCHAR'", "str?": f"{t} NOT IN ('VARCHAR', 'NULL')", "bool": f"{t} <> 'BOOLEAN'",
        "number": f"NOT ({number})", "int": f"{t} NOT IN ('BIGINT', 'UBIGINT')", "dict": f"{t} <> 'OBJECT'",
        "unit": f"CASE WHEN {number} THEN NOT ({text}::DOUBLE BETWEEN 0 AND 1) ELSE true END",
        "strs": f"{t} <> 'ARRAY' OR len(list_filter({items}, lambda i: json_type(i) <> 'VARCHAR')) > 0",
        "ints2": f"{t} <> 'ARRAY' OR len({items}) <> 2 OR len(list_filter({items}, lambda i: json_type(i) NOT IN ('BIGINT', 'UBIGINT'))) > 0",
    }
    if kind == "box":
        wrong = f"{t} <> 'ARRAY' OR len({items}) <> 4 OR len(list_filter({items}, lambda i: json_type(i) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) > 0"
        return f"CASE WHEN {wrong} THEN 'must be 4 numbers' WHEN {at(0)} > {at(2)} THEN 'ymin > ymax' WHEN {at(1)} > {at(3)} THEN 'xmin > xmax' END"
    return f"CASE WHEN {tests[kind]} THEN 'must be {kind}' END"


def _object_sql(j, spec, prefix):
    """List of problems of a JSON object, in SQL; ``prefix`` is a SQL text."""
    keys = f"json_keys({j})"
    names = sql_list(sorted(spec))
    missing = f"list_filter({names}, lambda k: NOT list_contains({keys}, k))"
    extra = f"list_sort(list_filter({keys}, lambda k: NOT list_contains({names}, k)))"
    parts = [f"""[CASE WHEN len({missing}) > 0 THEN {prefix} || 'missing ' || array_to_string({missing}, ',') END,
                  CASE WHEN len({extra}) > 0 THEN {prefix} || 'unexpected ' || array_to_string({extra}, ',') END]"""]
    for name, kind in spec.items():
        value, here = f"json_extract({j}, '$.{name}')", f"{prefix} || '{name}'"
        if isinstance(kind, dict):
            found = f"CASE WHEN json_type({value}) <> 'OBJECT' THEN [{here} || ': must be dict'] ELSE {_object_sql(value, kind, here + chr(32) + '||' + chr(32) + quote('.'))} END"
        elif isinstance(kind, tuple):
            items = f"json_extract({value}, '$[*]')"
            item = f"{here} || '[' || (i - 1) || '].'"
            each = f"flatten(list_transform({items}, lambda b, i: CASE WHEN json_type(b) <> 'OBJECT' THEN [{item} || 'must be dict'] ELSE {_object_sql('b', kind[0], item)} END))"
            found = f"CASE WHEN json_type({value}) <> 'ARRAY' THEN [{here} || ': must be list'] ELSE {each} END"
        else:
            found = f"[{here} || ': ' || {_type_sql(value, kind)}]"
        parts.append(f"CASE WHEN list_contains({keys}, '{name}') THEN {found} ELSE [] END")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def violations_sql(j, spec):
    """Problems joined by '; ' as text."""
    return f"array_to_string(list_filter({_object_sql(j, spec, quote(''))}, lambda m: m IS NOT NULL), '; ')"


_RESULTS = "CASE task " + " ".join(f"WHEN '{t}' THEN {violations_sql('payload::JSON', s)}" for t, s in trace.RESULT_SPECS.items()) + " END"
EXTRA = {
    **ROUTING_VIEWS,
    **SCENE_VIEWS,
    "v_bad": f"SELECT rid, task, payload, {_RESULTS} AS violations FROM v_payload",
    "v_trace_text": f"""
        SELECT event_id AS rid, replace(replace(({sql_list(TRACES)})[event_id % {len(TRACES)} + 1], '{{id}}', event_id::VARCHAR), '{{v}}', printf('%.2f', value)) AS trace FROM events""",
    "v_run": """
        SELECT r.qid, r.ts, r.user_id, r.query, r.task, r.mechanism, r.matched, r.score, n_inputs, i.ie,
               (task IN ('change', 'fusion') AND n_inputs <> 2) OR (task NOT IN ('change', 'fusion') AND n_inputs > 2) OR ie > 0
               OR (task = 'fusion' AND n_inputs = 2 AND am <> 'sar' AND bm <> 'sar' AND am <> 'unknown' AND bm <> 'unknown') AS refused,
               100 + r.qid % 900 + r.qid % 7 + r.qid % 11 AS total_ms
        FROM v_routed r JOIN (SELECT run_id, sum(len(errors))::INT AS ie, max(coalesce(modality, 'unknown')) FILTER (ord = 0) AS am, max(coalesce(modality, 'unknown')) FILTER (ord = 1) AS bm
              FROM v_inspect GROUP BY 1) i ON i.run_id = r.qid""",
    "v_state": "SELECT *, CASE WHEN refused THEN 'validation_failed' WHEN qid % 13 = 0 THEN 'error' ELSE 'success' END AS status FROM v_run",
}


def traces(spark, sf, q=None):
    """Trace rows of all requests, or of those given; every thirteenth run crashes."""
    q = V.queries(spark, sf) if q is None else q
    requests = routing.route(q).withColumnRenamed("qid", "run_id")
    checked = catalog.check_pairs(requests, V.inputs_of(q, V.scene_count(spark, sf)), guarded(spark, sf), extra=[trace.input_list()])
    e = F.col("qid")
    payload = F.concat(F.lit('{"text_response":"answer '), e.cast("string"), F.lit('","confidence":0.5,"confidence_basis":"heuristic"}'))
    results = q.select(e.alias("run_id"), F.when(e % 13 != 0, payload).alias("payload"))
    parts = (e % 7, e % 11, 100 + e % 900, 100 + e % 900 + e % 7 + e % 11)
    names = ("routing_ms", "validation_ms", "inference_ms", "total_ms")
    timings = q.select(e.alias("run_id"), *[p.cast("int").alias(n) for p, n in zip(parts, names)])
    return trace.build_traces(checked, results, timings)


@query("p25_validate_results", "SELECT rid, task, violations FROM v_bad", EXTRA)
def p25(spark, sf):
    return trace.validate_results(V.payloads(spark, sf)).select("rid", "task", F.array_join("violations", "; ").alias("violations"))


@query("u2_key_differences", "SELECT rid, array_to_string(list_filter(a, lambda k: NOT list_contains(b, k)), ',') AS missing, array_to_string(list_sort(list_filter(b, lambda k: NOT list_contains(a, k))), ',') AS unexpected FROM (SELECT rid, json_keys(payload) AS b, CASE task " + " ".join(
    f"WHEN '{t}' THEN {sql_list(sorted(s))}" for t, s in trace.RESULT_SPECS.items()) + " END AS a FROM v_payload)", EXTRA)
def u2(spark, sf):
    rows = trace.key_differences(V.payloads(spark, sf))
    return rows.select("rid", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


def trace_texts(spark, sf):
    e = F.col("event_id")
    table = F.array(*[F.lit(t) for t in TRACES])
    shown = F.element_at(table, (e % len(TRACES) + 1).cast("int"))
    return V.spread(V.load(spark, sf, "events"), "event_id").select(
        e.alias("rid"), F.replace(F.replace(shown, F.lit("{id}"), e.cast("string")), F.lit("{v}"), V.fixed("value", "0.00")).alias("trace"))


@query("p26_validate_traces", f"SELECT rid, {violations_sql('trace::JSON', trace.TRACE_SPEC)} AS violations FROM v_trace_text", EXTRA)
def p26(spark, sf):
    return trace.validate_traces(trace_texts(spark, sf)).select("rid", F.array_join("violations", "; ").alias("violations"))


@query("p28_classify_runs", """
    SELECT rid, basis, CASE WHEN basis IS NULL OR basis NOT IN ('stub', 'heuristic', 'calibrated', 'model_logprob') THEN 'contract_violation' WHEN basis = 'stub' THEN 'PLACEHOLDER' ELSE 'measured' END AS status
    FROM (SELECT rid, payload ->> '$.confidence_basis' AS basis FROM v_payload)""")
def p28(spark, sf):
    rows = V.payloads(spark, sf).select("rid", F.get_json_object("payload", "$.confidence_basis").alias("basis"))
    return trace.classify_runs(rows)


@query("p29_artifacts", """
    SELECT rid, CASE task WHEN 'change' THEN payload ->> '$.change_mask_path' WHEN 'fusion' THEN payload ->> '$.agreement_map_path' END AS mask,
           CASE WHEN task IN ('change', 'fusion', 'grounding') THEN payload ->> '$.overlay_path' END AS overlay FROM v_payload""")
def p29(spark, sf):
    rows = V.payloads(spark, sf).select("rid", trace.artifacts(F.col("task"), F.col("payload")).alias("a"))
    return rows.select("rid", "a.mask", "a.overlay")


@query("p32_logprob_confidence", """
    SELECT run_id, count(*) AS tokens, round(CASE WHEN m IS NULL THEN 0 ELSE greatest(0.0, least(1.0, exp(m))) END, 6) AS confidence, CASE WHEN m IS NULL THEN 'heuristic' ELSE 'model_logprob' END AS basis
    FROM (SELECT run_id, logprob, avg(logprob) FILTER (isfinite(logprob)) OVER (PARTITION BY run_id) AS m FROM v_tok) GROUP BY run_id, m""")
def p32(spark, sf):
    return trace.logprob_confidence(V.tokens(spark, sf)).select("run_id", "tokens", six("confidence"), "basis")


@query("j21_merge_models", """
    SELECT run_id, ord, role, CASE WHEN run_id % 3 = 0 AND role <> 'encoder' THEN 'loaded-' || role ELSE 'planned-' || role END AS name,
           CASE WHEN run_id % 3 = 0 AND role <> 'encoder' THEN 'cuda' ELSE 'cpu' END AS device
    FROM (SELECT qid AS run_id, unnest(r) AS role, unnest(range(0, len(r)))::INT AS ord FROM (
      SELECT qid, CASE WHEN gold_task = 'grounding' THEN ['grounding'] WHEN gold_task IN ('vqa', 'caption') THEN ['vqa'] ELSE ['encoder', 'vqa'] END AS r FROM v_query))""")
def j21(spark, sf):
    q = V.queries(spark, sf)
    runs = q.select(F.col("qid").alias("run_id"), F.col("gold_task").alias("task"))
    role = F.explode(F.array(F.lit("vqa"), F.lit("grounding")))
    loads = q.where("qid % 3 = 0").select(F.col("qid").alias("run_id"), role.alias("role")).select(
        "run_id", "role", F.concat(F.lit("loaded-"), "role").alias("name"), F.lit("r1").alias("revision"), F.lit("fp16").alias("precision"),
        F.lit(None).cast("string").alias("adapter"), F.lit("cuda").alias("device"))
    roles = F.explode(F.array(*[F.lit(r) for r in ("vqa", "grounding", "encoder")]))
    registry = spark.range(1).select(roles.alias("role")).select(
        "role", F.concat(F.lit("planned-"), "role").alias("name"), F.lit("r0").alias("revision"), F.lit("fp32").alias("precision"), F.lit("cpu").alias("device"))
    return trace.merge_models(runs, loads, registry).select("run_id", "ord", "role", "name", "device")


@query("s12_write_traces", "SELECT ts::DATE AS date, task, status, count(*) AS n FROM v_state GROUP BY ALL", EXTRA)
def s12(spark, sf):
    path = scratch_path(spark, "traces")
    trace.write_traces(traces(spark, sf), path)
    return spark.read.parquet(path).groupBy("date", "task", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s18_report_rows", """
    SELECT 'run-' || qid AS run_id, query, task, CASE WHEN status = 'success' THEN 'answer ' || qid END AS answer, CASE WHEN status = 'success' THEN '0.50 (Heuristic estimate)' END AS confidence,
           status, mechanism, matched, round(score, 3) AS score, total_ms FROM v_state""", EXTRA)
def s18(spark, sf):
    return trace.report_rows(traces(spark, sf)).select(
        "run_id", "query", "task", "answer", "confidence", "status", "mechanism", "matched", "score", F.col("total_ms").cast("long").alias("total_ms"))


@query("a25_trace_stats", """
    SELECT coalesce(task, 'all') AS task, coalesce(status, 'all') AS status, count(*) AS runs, count(*) FILTER (mechanism = 'rule') AS by_rule, round(avg(total_ms), 6) AS mean_ms, max(total_ms) AS max_ms,
           quantile_disc(total_ms, 0.5) AS p50_ms, quantile_disc(total_ms, 0.95) AS p95_ms
    FROM v_state GROUP BY CUBE (task, status)""", EXTRA)
def a25(spark, sf):
    rows = trace.trace_stats(traces(spark, sf))
    return rows.select("task", "status", "runs", "by_rule", six("mean_ms"), *[F.col(c).cast("long").alias(c) for c in ("max_ms", "p50_ms", "p95_ms")])


@query("p30_fusion_text", """
    SELECT event_id AS rid, 'Cross-modal fusion of optical (msi, 4-band) and SAR (sar, 2-band) data. BEN predictions: ' || (event_id % 6) || ' classes agree (' || printf('%.0f', (event_id % 6) * 20.0) || '%), '
       || (event_id % 3) || ' optical-only, ' || (event_id % 4) || ' SAR-only.' || CASE WHEN event_id % 2 = 0 THEN ' SAR physics: potential water body detected (low VV backscatter).' ELSE '' END
       || CASE WHEN event_id % 5 = 0 THEN ' SAR physics: possible built-up area (high backscatter + double-bounce).' ELSE '' END AS text FROM events""")
def p30_fusion(spark, sf):
    e = F.col("event_id")
    return V.load(spark, sf, "events").select(e.alias("rid"), fusion_text(
        F.lit("msi, 4-band"), F.lit("sar, 2-band"), e % 6, (e % 6) * 20.0, e % 3, e % 4, e % 2 == 0, e % 5 == 0).alias("text"))


def stream_queries(spark, sf, closing=None):
    """Events arriving as a stream, turned into queries by the batch view."""
    events = jobs.read_events(spark, sf, closing=closing, pieces=spark.sparkContext.defaultParallelism)
    return V.queries_of(events)


def end_mark(spark, sf, days=1):
    """An end mark a day after the last event."""
    last = V.load(spark, sf, "events").agg(F.max("ts").alias("ts")).first()["ts"]
    return jobs.Closing(spark, last + datetime.timedelta(days=days))


@query("t1_route_stream", "SELECT qid, task, mechanism, matched FROM v_routed", EXTRA)
def t1(spark, sf):
    routed = jobs.route_stream(stream_queries(spark, sf)).select("qid", "task", "mechanism", "matched")
    return jobs.run_once(routed, "routed")


@query("t2_validate_stream", """
    SELECT run_id, ord, coalesce(modality, 'none') AS modality, CASE WHEN modality IS NULL THEN 0 ELSE len(warnings) END AS warnings, len(errors) AS errors FROM v_inspect""", EXTRA)
def t2(spark, sf):
    arriving = V.inputs_of(stream_queries(spark, sf), V.scene_count(spark, sf))
    checked = jobs.validate_stream(arriving, guarded(spark, sf)).select(
        "run_id", "ord", F.coalesce("modality", F.lit("none")).alias("modality"), F.size("warnings").cast("long").alias("warnings"), F.size("errors").cast("long").alias("errors"))
    return jobs.run_once(checked, "checked")


_STATUS = "CASE WHEN (task IN ('change', 'fusion') AND n_inputs <> 2) OR n_inputs > 2 THEN 'validation_failed' ELSE 'success' END"


@query("t3_trace_sink", "SELECT ts::DATE AS date, task, status, count(*) AS runs, sum(n_inputs)::BIGINT AS inputs FROM v_state GROUP BY ALL", EXTRA)
def t3(spark, sf):
    rows = jobs.trace_sink(stream_queries(spark, sf), lambda q: traces(q.sparkSession, sf, q), "trace-sink")
    return rows.groupBy("date", "task", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("inputs")).alias("inputs"))


@query("t4_counts_per_window", f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, task, {_STATUS} AS status, count(*) AS runs FROM v_routed GROUP BY ALL""", EXTRA)
def t4(spark, sf):
    end = end_mark(spark, sf)
    rows = jobs.with_status(jobs.route_stream(stream_queries(spark, sf, end)))
    return jobs.run_once(jobs.counts_per_window(rows), "windows", closing=end).select(F.col("start").cast("timestamp_ntz").alias("start"), "task", "status", "runs")


@query("t5_sessions", """
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS runs FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s""")
def t5(spark, sf):
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    end = end_mark(spark, sf)
    return jobs.run_once(jobs.sessions(stream_queries(spark, sf, end)), "sessions", closing=end).select("user_id", plain("start"), plain("end"), "runs")


@query("t6_drop_repeats", "SELECT event_id AS qid FROM events")
def t6(spark, sf):
    arriving = stream_queries(spark, sf).select("qid", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return jobs.run_once(jobs.drop_repeats(arriving), "distinct").select("qid")


#: Days of events that arrive together in the query.
ARRIVE_DAYS = 8


@query("t7_change_state", """
    SELECT user_id AS location, ts, round(value / 500, 6) AS fraction, round(value / 500 - lag(value / 500) OVER (PARTITION BY user_id ORDER BY ts, value), 6) + 0.0 AS delta FROM events""")
def t7(spark, sf):
    # later than the last event by more than the watermark's delay
    end = end_mark(spark, sf, ARRIVE_DAYS + 1)
    folder = scratch_path(spark, "arrivals")
    # a trigger takes the files of a span of days, so that larger inputs have larger triggers and not more of them
    pieces = spark.sparkContext.defaultParallelism
    schema = jobs.arrivals(V.load(spark, sf, "events"), folder, ARRIVE_DAYS, pieces)
    events = jobs.read_events(spark, folder, "*.parquet", schema, files_per_batch=pieces, closing=end)
    masks = events.select(F.col("user_id").alias("location"), "ts", (F.col("value") / 500).alias("fraction"))
    changed = jobs.run_once(jobs.change_state(masks, f"{ARRIVE_DAYS} days"), "change-state", closing=end)
    return changed.select("location", F.col("ts").cast("timestamp_ntz").alias("ts"), six("fraction"), six("delta"))
