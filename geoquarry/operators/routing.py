"""Query routing as column expressions.

The route is a projection: it needs no join and no shuffle, so the same columns
serve a batch table and a stream.
"""

import math
import re

from pyspark.sql import functions as F

from geoquarry.functions.text import fixed, literal, strip
from geoquarry.operators.rules import (
    EXEMPLAR_FLOOR, EXEMPLARS, REFERENCES, RULE_STRENGTH, RULES, SINGLE_IMAGE, STOP_WORDS, TARGET_ARTICLE,
    TARGET_EDGE, TARGET_LEAD, TARGET_TRAIL, TARGET_WHERE, TASKS, WHOLE_EDGE,
)

#: Ignore case, treat letters and spaces as Unicode, end lines at \n only.
FLAGS = "(?idU)"


def pattern(text):
    return F.lit(FLAGS + text)


STOP_LIST = "array(" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + ")"


def router_tokens(text):
    """ASCII words of two letters or more that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.expr(STOP_LIST)
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def _tokens(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS and len(w) > 1]


EXAMPLES = [(task, text) for task in TASKS for text in EXEMPLARS[task]]
EXAMPLE_TASKS = "array(" + ", ".join(literal(t) for t, _ in EXAMPLES) + ")"
EXAMPLE_TEXTS = "array(" + ", ".join(literal(x) for _, x in EXAMPLES) + ")"


def _weights():
    """Per token its idf and its weight in every example; the example norms."""
    docs = [_tokens(text) for _, text in EXAMPLES]
    words = sorted({w for d in docs for w in d})
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in words}
    rows = {w: [d.count(w) * idf[w] for d in docs] for w in words}
    norms = [math.sqrt(sum(idf[w] ** 2 for w in d)) for d in docs]
    return idf, rows, norms


IDF, WEIGHTS, NORMS = _weights()


def rule_hits(column):
    """All rules the text in ``column`` matches, in order: array of (ordinal, task, name)."""
    tests = ", ".join(
        f"CASE WHEN regexp_like({column}, {literal(FLAGS + p)}) "
        f"THEN named_struct('ordinal', {i}, 'task', '{task}', 'name', '{name}') END"
        for i, (task, name, p) in enumerate(RULES)
    )
    return F.expr(f"filter(array({tests}), h -> h IS NOT NULL)")


def first_hit(column):
    """The first rule the text in ``column`` matches (W6): later patterns are not tried."""
    chain = " ".join(
        f"WHEN regexp_like({column}, {literal(FLAGS + p)}) THEN named_struct('ordinal', {i}, 'task', '{task}', 'name', '{name}')"
        for i, (task, name, p) in enumerate(RULES)
    )
    return F.expr(f"CASE {chain} END")


def _numbers(values):
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _table(rows):
    """A token map as one literal: the optimiser folds it once per query."""
    return "map(" + ", ".join(f"'{w}', {v}" for w, v in rows.items()) + ")"


WEIGHT_TABLE = _table({w: _numbers(v) for w, v in WEIGHTS.items()})
IDF_TABLE = _table({w: f"{v!r}D" for w, v in IDF.items()})
NORM_LIST = _numbers(NORMS)


def exemplar_scores(words):
    """Weighted cosine with every example, in example order; null without a known word.

    A repeated query word adds its weight each time; an example's length adds the
    squared weight of each occurrence.
    """
    table, idf, norms = F.expr(WEIGHT_TABLE), F.expr(IDF_TABLE), F.expr(NORM_LIST)
    weighted = F.filter(
        F.transform(words, lambda w: F.struct(w.alias("w"), F.element_at(idf, w).alias("idf"))),
        lambda t: t["idf"].isNotNull(),
    )
    # one pass: dot products and, per distinct word, its summed weight
    start = F.struct(
        F.array_repeat(F.lit(0.0), len(EXAMPLES)).alias("dots"), F.lit(0.0).alias("squares"),
        F.array().cast("array<string>").alias("seen"),
    )

    def add(acc, t):
        times = F.size(F.filter(acc["seen"], lambda s: s == t["w"]))
        return F.struct(
            F.zip_with(acc["dots"], F.element_at(table, t["w"]), lambda s, v: s + v * t["idf"]).alias("dots"),
            # the square of k+1 weights less the square of k
            (acc["squares"] + (2 * times + 1) * t["idf"] * t["idf"]).alias("squares"),
            F.concat(acc["seen"], F.array(t["w"])).alias("seen"),
        )

    return F.aggregate(
        weighted, start, add,
        lambda acc: F.when(
            acc["squares"] > 0,
            F.zip_with(acc["dots"], norms, lambda d, n: d / (F.sqrt(acc["squares"]) * n)),
        ),
    )


def ranked_tasks(scores):
    """Best score per task, best task first; ties keep the task order."""
    best, start = [], 1
    for order, task in enumerate(TASKS):
        n = len(EXEMPLARS[task])
        best.append(F.struct(
            (-F.array_max(F.slice(scores, start, n))).alias("key"), F.lit(order).alias("order"), F.lit(task).alias("task")))
        start += n
    return F.when(scores.isNotNull(), F.array_sort(F.array(*best)))


def image_reference(query):
    """second, first, both or unspecified."""
    chain = None
    for name, p in REFERENCES:
        test = F.regexp_like(query, pattern(p))
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("unspecified")


def _cleaned(queries):
    """qid and stripped text as a column, so that no pattern strips it again."""
    return queries.select("qid", strip(F.col("query")).alias("q"))


def rule_matches(queries):
    """One row per query and matching rule."""
    found = _cleaned(queries).select("qid", rule_hits("q").alias("hits"))
    # the outer form keeps the optimiser from testing the array, and so the rules, twice
    return found.select("qid", F.explode_outer("hits").alias("h")).where("h is not null").select("qid", "h.*")


def first_rule(queries):
    """First rule of each query, null when none matches."""
    return _cleaned(queries).select("qid", first_hit("q").alias("h")).select(
        "qid", F.col("h.ordinal").alias("ordinal"), F.col("h.task").alias("task"), F.col("h.name").alias("name")
    )


def exemplar_matches(queries):
    """One row per query and example with a positive score."""
    names, texts = F.expr(EXAMPLE_TASKS), F.expr(EXAMPLE_TEXTS)
    scored = _cleaned(queries).select("qid", exemplar_scores(router_tokens(F.col("q"))).alias("scores"))
    rows = scored.select("qid", F.posexplode_outer("scores").alias("example", "score")).where("score > 0")
    return rows.select(
        "qid", "example", F.get(names, F.col("example")).alias("task"), F.get(texts, F.col("example")).alias("text"), "score"
    )


def best_tasks(queries):
    """Tasks of each query ranked by their best example."""
    scored = _cleaned(queries).select("qid", exemplar_scores(router_tokens(F.col("q"))).alias("scores"))
    ranked = scored.select("qid", ranked_tasks(F.col("scores")).alias("ranked"))
    return ranked.select("qid", F.posexplode_outer("ranked").alias("rank", "r")).where("r is not null").select(
        "qid", "rank", F.col("r.task").alias("task"), (-F.col("r.key")).alias("score")
    )


def route(queries):
    """Add the routing decision to each query.

    Columns added: task, mechanism, matched, score, alternatives, exemplar,
    reference, image_index, image_note, note.
    """
    base = queries.withColumn("_q", strip(F.coalesce("query", F.lit("")))).withColumn("_hits", rule_hits("_q"))
    hit = F.get("_hits", F.lit(0))
    # words are empty for a query a rule has decided, so it costs nothing here
    words = F.when(F.size("_hits") == 0, router_tokens(F.col("_q")))
    scored = base.withColumn("_scores", exemplar_scores(words)).withColumn("_ranked", ranked_tasks(F.col("_scores")))
    top = F.get("_ranked", F.lit(0))
    by_rule = F.size("_hits") > 0
    near = ~by_rule & F.coalesce(-top["key"] >= EXEMPLAR_FLOOR, F.lit(False))
    others = F.transform(
        F.filter("_hits", lambda h: h["task"] != hit["task"]),
        lambda h: F.concat(h["task"], F.lit(" ("), h["name"], F.lit(")")),
    )
    ranked = F.transform(
        F.slice("_ranked", 2, 3),
        lambda r: F.concat(r["task"], F.lit("(score="), fixed(-r["key"], "0.000"), F.lit(")")),
    )
    texts = F.expr(EXAMPLE_TEXTS)
    none = F.array().cast("array<string>")
    decided = scored.select(
        *queries.columns,
        F.when(by_rule, hit["task"]).when(near, top["task"]).otherwise("vqa").alias("task"),
        F.when(by_rule, "rule").otherwise("exemplar_nn").alias("mechanism"),
        F.when(by_rule, hit["name"]).when(near, F.concat(F.lit("exemplar:"), top["task"]))
        .otherwise("default:vqa_fallback").alias("matched"),
        F.when(by_rule, RULE_STRENGTH).when(near, -top["key"]).otherwise(0.0).alias("score"),
        F.when(by_rule, F.array_distinct(others)).otherwise(F.coalesce(ranked, none)).alias("alternatives"),
        F.when(near, F.get(texts, (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int"))).alias("exemplar"),
        image_reference(F.col("_q")).alias("reference"),
    )
    n, ref = F.coalesce("n_inputs", F.lit(0)), F.col("reference")
    decided = decided.withColumns({
        "image_index": F.when((ref == "second") & (n >= 2), 1).otherwise(0),
        "image_note": F.when((ref == "second") & (n >= 2), "second-or-later image")
        .when(ref == "second", "second image referenced but only one supplied; using image 1")
        .otherwise("first image"),
    })
    task, count = F.col("task"), n.cast("string")
    single = task.isin(SINGLE_IMAGE)
    chosen = F.when(ref == "second", F.concat(F.lit("image "), (F.col("image_index") + 1).cast("string"))).otherwise("image 1")
    return decided.withColumn("note", F.concat_ws(
        "; ",
        F.concat(F.lit("routing via "), F.col("mechanism"), F.lit(" ("), F.col("matched"), F.lit(")")),
        F.when(single & (n >= 2), F.concat(
            F.lit("single-image task '"), task, F.lit("' selected from query text despite "), count,
            F.lit(" inputs; default single-image task runs on "), chosen)),
        F.when(single & (n >= 2) & (ref == "both"), F.lit(
            "query refers to 'both images'; controller runs single-image analyses one image at a time and defaults to image 1")),
        F.when(single & (n < 2) & (ref == "second"), F.lit(
            "query references a second image but only 1 was supplied; using image 1")),
        F.when(single & (n < 2) & (ref != "second"), F.concat(
            F.lit("single-image task '"), task, F.lit("' runs on the one supplied image"))),
        F.when(~single & (n < 2), F.concat(
            F.lit("task '"), task, F.lit("' needs 2 images but "), count,
            F.lit(" were supplied — validation will refuse this run; routing is query-driven by design (R4)"))),
        F.when(~single & (n >= 2), F.concat(F.lit("task '"), task, F.lit("' accepts the "), count, F.lit(" supplied images"))),
    ))


def grounding_target(query):
    """The thing a locating query asks for."""
    cut = F.regexp_replace(query, pattern(TARGET_LEAD), F.lit(" "))
    for p in (TARGET_WHERE, TARGET_TRAIL, TARGET_EDGE, TARGET_ARTICLE):
        cut = F.regexp_replace(cut, pattern(p), F.lit(""))
    return F.when(F.length(cut) > 1, cut).otherwise(F.regexp_replace(query, pattern(WHOLE_EDGE), F.lit("")))


def idf(documents, text="query"):
    """ln((1+N)/(1+df))+1 over the tokens of distinct texts."""
    docs = documents.select(text).distinct()
    words = docs.select(F.explode(F.array_distinct(router_tokens(F.col(text)))).alias("token"))
    df = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # the document count is one number, read as a scalar subquery
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.select("token", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def routing_accuracy(routed):
    """n, correct and accuracy per gold task and in total."""
    right = F.sum(F.when(F.col("gold_task") == F.col("task"), 1).otherwise(0))
    rows = routed.rollup("gold_task").agg(F.count(F.lit(1)).alias("n"), right.alias("correct"))
    return rows.select(
        F.coalesce("gold_task", F.lit("all")).alias("gold_task"), "n", "correct",
        F.coalesce(F.try_divide("correct", "n"), F.lit(0.0)).alias("accuracy"),
    )


def confusion_matrix(routed):
    """Gold rows by predicted columns, zero cells kept."""
    names = F.array(*[F.lit(t) for t in TASKS])
    every = routed.sparkSession.range(1).select(F.explode(names).alias("gold_task"))
    cells = routed.groupBy("gold_task").pivot("task", TASKS).count()
    return every.join(cells, "gold_task", "left").select(
        "gold_task", *[F.coalesce(t, F.lit(0)).alias(t) for t in TASKS]
    )
