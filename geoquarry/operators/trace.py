"""Run traces: contracts, models, confidences, report rows, statistics
(P25, P26, P28, P29, P32, P34, J21, A25, S12, S18, U2)."""

from pyspark.sql import functions as F

from geoquarry.functions.text import fixed
from geoquarry.operators.rules import TASKS
from geoquarry.operators.scale import finite

# Domains, roles, labels, prompt texts.
BASES = ["calibrated", "heuristic", "model_logprob", "stub"]
MECHANISMS = ["exemplar_nn", "rule"]
MODALITIES = ["msi", "optical", "sar", "unknown"]
TASK_ROLES = {
    "vqa": ["vqa"], "caption": ["vqa"], "grounding": ["grounding"],
    "change": ["encoder", "vqa"], "fusion": ["encoder", "vqa"],
}
BASIS_LABELS = {
    "stub": "Placeholder — specialist not yet implemented",
    "heuristic": "Heuristic estimate",
    "calibrated": "Calibrated probability",
    "model_logprob": "Model log-probability",
}
PROMPT_LABELS = 5
SYSTEM_PROMPT = (
    "You are a remote-sensing vision assistant. You analyse single-frame optical, multispectral, and SAR "
    "satellite/aerial imagery. Base your answer only on what is visible in the image (and any land-cover "
    "evidence given below)."
)
EVIDENCE_LEAD = (
    "\nLand-cover evidence from an RS-adapted encoder (highest similarity first, not ground truth): "
)
VQA_ASK = (
    "\n\nAnswer the following question about this satellite image. Give the shortest possible correct answer "
    "-- a single word, a short phrase, or a bare number (e.g. 'yes', 'no', 'urban', 'rural', '3'). Do not "
    "explain your reasoning.\n\nQuestion: "
)
CAPTION_ASK = (
    "\n\nDescribe this satellite image in one or two concise sentences: the dominant land cover / land use "
    "and the most salient visible features. Do not speculate about anything outside the frame."
)

TEXT_RESULT = {"text_response": "str", "confidence": "unit", "confidence_basis": BASES, "evidence": "dict"}
BOX = {"label": "str", "confidence": "unit", "box_2d": "box"}
#: Fields and kinds of each result: a list is a domain, a dict an object, a
#: one-element tuple an array of objects.
RESULT_SPECS = {
    "vqa": TEXT_RESULT,
    "caption": TEXT_RESULT,
    "grounding": {
        "text_response": "str", "bounding_boxes": (BOX,), "overlay_path": "str?", "confidence": "unit",
        "confidence_basis": BASES},
    "change": {
        "text_response": "str", "change_mask_path": "str?", "overlay_path": "str?", "metrics": "dict",
        "confidence": "unit", "confidence_basis": BASES, "evidence": "dict"},
    "fusion": {
        "text_response": "str", "agreement_map_path": "str?", "overlay_path": "str?", "evidence": "dict",
        "confidence": "unit", "confidence_basis": BASES},
}
BAND_MAPPING_SPEC = {
    "slots_filled": "strs", "slots_absent": "strs", "fill_strategy": "str", "source_modality": MODALITIES}
TRACE_SPEC = {
    "run_id": "str", "timestamp": "str", "query": "str", "task_selected": sorted(TASKS),
    "routing": {"mechanism": MECHANISMS, "matched": "str", "score": "number", "alternatives_considered": "strs"},
    "inputs": ({
        "path": "str", "modality": MODALITIES, "bands": "int", "shape": "ints2", "format": "str", "crs": "str?",
        "checks_passed": "bool"},),
    "validation": {"passed": "bool", "warnings": "strs", "errors": "strs"},
    "models_used": ({
        "role": "str", "name": "str", "revision": "str", "precision": "str", "adapter": "str?", "device": "str"},),
    "parameters": "dict", "result": "dict",
    "artifacts": {"mask": "str?", "overlay": "str?", "report": "str?"},
    "timings_ms": {"routing": "number", "validation": "number", "inference": "number", "total": "number"},
}


def _object(v):
    """Fields of a variant object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v):
    """Items of a variant array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _type(v):
    return F.schema_of_variant(v)


def _is_number(t):
    return t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _words(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def key_sets(present, required):
    """Missing and unexpected keys of an object."""
    wanted = _words(sorted(required))
    return F.array_except(wanted, present), F.array_sort(F.array_except(present, wanted))


def _value_problem(v, kind):
    """Null when a variant value is of the kind, else a short reason."""
    if kind in ("dict", "strs", "ints2", "box"):
        items = _list(v)
        if kind == "dict":
            return F.when(_object(v).isNull(), "must be dict")
        if kind == "strs":
            bad = items.isNull() | F.exists(items, lambda i: F.coalesce(_type(i), F.lit("VOID")) != "STRING")
            return F.when(bad, "must be strs")
        if kind == "ints2":
            bad = items.isNull() | (F.size(items) != 2) | F.exists(items, lambda i: _type(i) != "BIGINT")
            return F.when(bad, "must be ints2")
        wrong = items.isNull() | (F.size(items) != 4) | F.exists(items, lambda i: ~_is_number(_type(i)))
        at = lambda i: F.try_variant_get(v, f"$[{i}]", "double")
        return F.when(wrong, "must be 4 numbers").when(at(0) > at(2), "ymin > ymax").when(at(1) > at(3), "xmin > xmax")
    t = _type(v)
    if isinstance(kind, list):
        bad = (t != "STRING") | ~F.try_variant_get(v, "$", "string").isin(kind)
        return F.when(bad, "not in domain")
    tests = {
        "str": t != "STRING",
        "str?": ~t.isin("STRING", "VOID"),
        "bool": t != "BOOLEAN",
        "number": ~_is_number(t),
        "int": t != "BIGINT",
        "unit": ~_is_number(t) | ~F.try_variant_get(v, "$", "double").between(0.0, 1.0),
    }
    return F.when(tests[kind], f"must be {kind}")


def _object_problems(fields, spec, prefix):
    """Array of problems of one object given as a map of its fields."""
    keys = F.map_keys(fields)
    missing, extra = key_sets(keys, spec)
    none = F.array().cast("array<string>")
    out = [
        F.array(
            F.when(F.size(missing) > 0, F.concat(prefix, F.lit("missing "), F.array_join(missing, ","))),
            F.when(F.size(extra) > 0, F.concat(prefix, F.lit("unexpected "), F.array_join(extra, ","))),
        )
    ]
    for name, kind in spec.items():
        value = F.try_element_at(fields, F.lit(name))
        here = F.concat(prefix, F.lit(name))
        if isinstance(kind, dict):
            inner = _object(value)
            found = F.when(inner.isNull(), F.array(F.concat(here, F.lit(": must be dict")))).otherwise(
                _object_problems(inner, kind, F.concat(here, F.lit("."))))
        elif isinstance(kind, tuple):
            items = _list(value)
            each = F.flatten(F.transform(items, lambda b, i: _item_problems(b, i, kind[0], here)))
            found = F.when(items.isNull(), F.array(F.concat(here, F.lit(": must be list")))).otherwise(each)
        else:
            found = F.array(F.concat(here, F.lit(": "), _value_problem(value, kind)))
        out.append(F.when(F.map_contains_key(fields, name), found).otherwise(none))
    return F.concat(*out)


def _item_problems(b, i, spec, here):
    prefix = F.concat(here, F.lit("["), i.cast("string"), F.lit("]."))
    inner = _object(b)
    return F.when(inner.isNull(), F.array(F.concat(prefix, F.lit("must be dict")))).otherwise(
        _object_problems(inner, spec, prefix))


def violations(fields, spec):
    """Problems of an object's fields against a field list, empty when it conforms."""
    found = F.array_compact(_object_problems(fields, spec, F.lit("")))
    return F.when(fields.isNull(), F.array(F.lit("not a JSON object"))).otherwise(found)


def _parsed(rows, column):
    """The fields of the JSON text, parsed once as a column of its own."""
    return rows.withColumn("_v", _object(F.try_parse_json(column)))


def validate_results(rows):
    """Add ``violations`` to (task, payload) rows (P25)."""
    chain = None
    for task, spec in RESULT_SPECS.items():
        found = violations(F.col("_v"), spec)
        chain = F.when(F.col("task") == task, found) if chain is None else chain.when(F.col("task") == task, found)
    checked = chain.otherwise(F.array(F.lit("unknown task")))
    return _parsed(rows, "payload").withColumn("violations", checked).drop("_v")


def validate_traces(rows, column="trace"):
    """Add ``violations`` to trace JSON texts."""
    found = violations(F.col("_v"), TRACE_SPEC)
    return _parsed(rows, column).withColumn("violations", found).drop("_v")


def validate_band_mappings(rows, column="band_mapping"):
    """Add ``violations`` to band-mapping JSON texts."""
    found = violations(F.col("_v"), BAND_MAPPING_SPEC)
    return _parsed(rows, column).withColumn("violations", found).drop("_v")


def split_valid(rows):
    """Conforming rows and the rest."""
    return rows.where(F.size("violations") == 0), rows.where(F.size("violations") > 0)


def key_differences(rows):
    """Missing and unexpected keys per payload."""
    keys = F.json_object_keys("payload")
    missing = extra = None
    for task, spec in RESULT_SPECS.items():
        m, e = key_sets(keys, spec)
        here = F.col("task") == task
        missing = F.when(here, m) if missing is None else missing.when(here, m)
        extra = F.when(here, e) if extra is None else extra.when(here, e)
    return rows.select("*", missing.alias("missing"), extra.alias("unexpected"))


def classify_runs(rows, basis="basis"):
    """measured, PLACEHOLDER or contract_violation by confidence basis."""
    b = F.col(basis)
    status = (
        F.when(b.isNull() | ~b.isin(BASES), "contract_violation").when(b == "stub", "PLACEHOLDER").otherwise("measured")
    )
    return rows.withColumn("status", status)


def artifacts(task, payload):
    """Mask, overlay and report paths of a result."""
    at = lambda key: F.get_json_object(payload, f"$.{key}")
    none = F.lit(None).cast("string")
    mask = F.when(task == "change", at("change_mask_path")).when(task == "fusion", at("agreement_map_path"))
    overlay = F.when(task.isin("change", "fusion", "grounding"), at("overlay_path"))
    return F.struct(mask.alias("mask"), overlay.alias("overlay"), none.alias("report"))


def logprob_confidence(rows, key="run_id"):
    """exp(mean finite token log-probability) within [0, 1] per run."""
    mean = F.avg(F.when(finite(F.col("logprob")), F.col("logprob")))
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("tokens"), mean.alias("_m"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp("_m")))
    return sums.select(
        key, "tokens",
        F.when(F.col("_m").isNull(), 0.0).otherwise(value).alias("confidence"),
        F.when(F.col("_m").isNull(), "heuristic").otherwise("model_logprob").alias("basis"),
    )


def evidence_text(top_scores):
    """The five best labels as prompt text; empty without labels."""
    parts = F.transform(
        F.slice(top_scores, 1, PROMPT_LABELS),
        lambda p: F.concat(p["label"], F.lit(" ("), fixed(p["score"], "0.00"), F.lit(")")),
    )
    return F.when(F.coalesce(F.size(top_scores), F.lit(0)) > 0,
                  F.concat(F.lit(EVIDENCE_LEAD), F.array_join(parts, ", "), F.lit("."))).otherwise("")


def detector_phrase(target):
    """Lower-case phrase ending in a period, ``object.`` when empty."""
    words = F.lower(F.trim(F.coalesce(target, F.lit(""))))
    words = F.when(words == "", "object").otherwise(words)
    return F.when(words.endswith("."), words).otherwise(F.concat(words, F.lit(".")))


def prompt_table(requests, labels, keys=("vec_id",)):
    """Prompts of a batch inference run.

    ``requests``: keys, ``query, target``; ``labels``: keys, ``label, score`` with
    a rank, already cut to the best labels of each scene.
    """
    keys = list(keys)
    top = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("top"))
    rows = requests.join(top, keys, "left")
    evidence = evidence_text(F.col("top"))
    return rows.select(
        *keys, "query",
        F.concat(F.lit(SYSTEM_PROMPT), evidence, F.lit(VQA_ASK), "query", F.lit("\nAnswer:")).alias("vqa_prompt"),
        F.concat(F.lit(SYSTEM_PROMPT), evidence, F.lit(CAPTION_ASK)).alias("caption_prompt"),
        detector_phrase(F.col("target")).alias("detector_prompt"),
    )


def planned_roles(task):
    """Roles a task uses, in order."""
    chain = None
    for name, roles in TASK_ROLES.items():
        here = F.when(task == name, _words(roles)) if chain is None else chain.when(task == name, _words(roles))
        chain = here
    return chain


def merge_models(traces, loads, registry):
    """Planned roles of each trace with the observed load where there is one.

    ``loads``: run_id, role, name, revision, precision, adapter, device;
    ``registry``: a small table role, name, revision, precision, device.
    """
    planned = traces.select("run_id", F.posexplode(planned_roles(F.col("task"))).alias("ord", "role"))
    facts = ["name", "revision", "precision", "adapter", "device"]
    seen = loads.select("run_id", "role", F.struct(*facts).alias("seen"))
    plan = registry.withColumn("adapter", F.lit(None).cast("string")).select("role", F.struct(*facts).alias("plan"))
    roles = sorted({r for rs in TASK_ROLES.values() for r in rs})
    # at most one row per known role
    known = plan.where(F.col("role").isin(roles)).groupBy("role").agg(F.first("plan").alias("plan"))
    rows = planned.join(seen, ["run_id", "role"], "left").join(F.broadcast(known), "role", "left")
    chosen = F.coalesce("seen", "plan")
    return rows.where(chosen.isNotNull()).select("run_id", "ord", "role", chosen.alias("m")).select("run_id", "ord", "role", "m.*")


def input_list():
    """Aggregate of a run's inspected inputs, in order, as its trace lists them."""
    info = F.struct(
        "ord",
        F.coalesce("path", F.lit("")).alias("path"), F.coalesce("modality", F.lit("unknown")).alias("modality"),
        F.coalesce("band_count", F.lit(0)).alias("bands"),
        F.array(F.coalesce("h", F.lit(0)), F.coalesce("w", F.lit(0))).alias("shape"),
        F.coalesce("format", F.lit("unknown")).alias("format"), "crs", F.col("path").isNotNull().alias("checks_passed"),
    )
    return F.array_sort(F.collect_list(info)).alias("inputs")


def build_traces(checked, results, timings):
    """One nested record per run: success, refusal or crash.

    ``checked`` holds the routed and checked requests with their ``inputs``;
    ``results``: run_id, payload (null for a crash); ``timings``: run_id and the
    four durations.
    """
    payload = F.when(~F.col("passed"), F.to_json(F.struct(F.lit("validation_failed").alias("status"), "errors"))).when(
        F.col("payload").isNull(), F.lit('{"status":"error"}')).otherwise(F.col("payload"))
    rows = checked.join(results, "run_id", "left").join(timings, "run_id", "left")
    task = F.col("task")
    return rows.select(
        F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("run_id"),
        F.col("ts").alias("timestamp"), "query", task.alias("task_selected"),
        F.struct("mechanism", "matched", "score", F.col("alternatives").alias("alternatives_considered")).alias("routing"),
        F.transform("inputs", lambda i: i.dropFields("ord")).alias("inputs"),
        F.struct("passed", "warnings", "errors").alias("validation"),
        payload.alias("result"),
        F.when(F.col("passed"), artifacts(task, F.col("payload"))).alias("artifacts"),
        F.struct("routing_ms", "validation_ms", "inference_ms", "total_ms").alias("timings_ms"),
        F.when(~F.col("passed"), "validation_failed").when(F.col("payload").isNull(), "error").otherwise("success").alias("status"),
    )


def write_traces(traces, path, mode="append"):
    """Append traces by day and task."""
    placed = traces.withColumns({"date": F.to_date("timestamp"), "task": F.col("task_selected")})
    # one file per small partition, several for a large one
    placed.hint("rebalance", "date", "task").write.mode(mode).partitionBy("date", "task").parquet(path)


def confidence_line(basis, confidence):
    """Confidence with the meaning of its basis."""
    chain = None
    for name, label in BASIS_LABELS.items():
        chain = F.when(basis == name, label) if chain is None else chain.when(basis == name, label)
    return F.concat(fixed(confidence, "0.00"), F.lit(" ("), chain.otherwise(basis), F.lit(")"))


def report_rows(traces):
    """Flat report columns of each trace."""
    at = lambda key: F.get_json_object("result", f"$.{key}")
    return traces.select(
        "run_id", "timestamp", "query", F.col("task_selected").alias("task"),
        F.array_join(F.transform("inputs", lambda i: F.concat(i["path"], F.lit(" ["), i["modality"], F.lit("]"))), ", ").alias("inputs"),
        at("text_response").alias("answer"),
        confidence_line(at("confidence_basis"), at("confidence").cast("double")).alias("confidence"),
        "status", F.col("routing.mechanism").alias("mechanism"), F.col("routing.matched").alias("matched"),
        F.round("routing.score", 3).alias("score"),
        F.array_join("routing.alternatives_considered", ", ").alias("alternatives"),
        F.array_join("validation.warnings", "; ").alias("warnings"), F.array_join("validation.errors", "; ").alias("errors"),
        F.col("timings_ms.routing_ms").alias("routing_ms"), F.col("timings_ms.validation_ms").alias("validation_ms"),
        F.col("timings_ms.inference_ms").alias("inference_ms"), F.col("timings_ms.total_ms").alias("total_ms"),
    )


def trace_stats(traces):
    """Runs, passes and durations by task and status, with totals."""
    cube = traces.cube(F.col("task_selected").alias("task"), "status").agg(
        F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("routing.mechanism") == "rule", 1)).alias("by_rule"),
        F.avg("timings_ms.total_ms").alias("mean_ms"), F.max("timings_ms.total_ms").alias("max_ms"),
        F.percentile_approx("timings_ms.total_ms", [0.5, 0.95], 10000).alias("q"),
    )
    return cube.select(
        F.coalesce("task", F.lit("all")).alias("task"), F.coalesce("status", F.lit("all")).alias("status"),
        "runs", "by_rule", "mean_ms", "max_ms", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"),
    )
