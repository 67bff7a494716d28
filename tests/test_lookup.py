"""Example tables, rule tables and kept sketches."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoquarry.operators import dataset, lookup, rules
from geoquarry.operators.routing import rule_matches
from geoquarry.plans import views


def test_anchors_are_in_every_match():
    texts = ["compare these two images", "what has changed between the dates", "how many ships are there", "fuse SAR and optical", "where is the river"]
    found = 0
    for _, name, pattern in rules.RULES:
        needed = lookup.anchors(pattern)
        found += needed is not None
        for text in texts + [" ".join(random.Random(i).sample(" ".join(texts).split(), 5)) for i in range(50)]:
            if needed and re.search(pattern, text, re.I):
                assert any(a in text.lower() for a in needed), (name, text)
    assert found > 0.7 * len(rules.RULES)
    assert lookup.anchors("(?:ab|xyz)?q+") is None and lookup.anchors(r"\b(?:water|flooded)\b") == {"water", "flooded"}
    assert lookup.anchors("(?:water|[0-9]+)") is None


def test_rule_table_hits_are_those_of_the_fixed_rules(spark, small_queries):
    flat = lambda df: sorted(map(tuple, df.select("qid", "ordinal", "task", "name").collect()))
    table = views.rule_table(spark)
    assert flat(lookup.rule_matches(small_queries, table)) == flat(rule_matches(small_queries))
    effort = lookup.tried_per_query(small_queries, table).agg(F.avg(F.col("tried") / F.col("rules")).alias("share"), F.count("qid").alias("n")).first()
    assert effort["share"] < 0.6 and effort["n"] == small_queries.count()


@pytest.fixture(scope="module")
def small_queries(spark):
    odd = [(-1, ""), (-2, "a"), (-3, "COMPARE THE TWO IMAGEſ"), (-4, "wa"), (-5, "K")]
    extra = spark.createDataFrame(odd, "qid long, query string")
    return views.queries(spark, "/root/testdata/sf0.001").select("qid", "query").unionByName(extra)


def brute_best(queries, examples, tasks):
    words = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w not in rules.STOP_WORDS]
    counted = [(task, Counter(words(t))) for _, task, t in examples]
    df = Counter(w for _, c in counted for w in c)
    idf = {w: math.log((1 + len(examples)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for q, text in queries:
        own = {w: n for w, n in Counter(words(text)).items() if w in idf}
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in own.items()))
        for task in tasks:
            scores = [sum(n * idf[w] ** 2 * c[w] for w, n in own.items()) / (length * math.sqrt(sum(m * idf[w] ** 2 for w, m in c.items()))) for t, c in counted if t == task and set(own) & set(c)]
            out[q, task] = max(scores, default=0.0)
    return out


def test_best_examples_equal_all_scores(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["common"] * 30
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    examples = [(i, rng.choice("abc"), text(rng.randint(1, 6))) for i in range(300)] + [(1000, "a", "the of"), (1001, "b", ""), (1002, "d", "only here")]
    queries = [(i, text(rng.randint(1, 5))) for i in range(60)] + [(100, "nothing known"), (101, ""), (102, "common"), (103, "here")]
    got = lookup.best_examples(spark.createDataFrame(queries, "qid long, query string"), spark.createDataFrame(examples, "example long, task string, text string"), list("abcd"))
    want = brute_best(queries, examples, "abcd")
    rows = {(r["qid"], r["task"]): r["score"] for r in got.collect()}
    assert rows == pytest.approx(want)


def test_words_of_examples_are_not_broadcast(spark, monkeypatch):
    examples = [(i, "ab"[i % 2], f"w{i % 7} w{i % 11} w{i % 13}") for i in range(200)]
    queries = [(i, f"w{i % 13} w{i % 7} w{i % 7}") for i in range(90)]
    frames = spark.createDataFrame(queries, "qid long, query string"), spark.createDataFrame(examples, "example long, task string, text string")
    plan = lookup._postings(frames[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # blocks of a few texts and examples give the same scores
    monkeypatch.setattr(lookup, "EXAMPLES", 40)
    monkeypatch.setattr(lookup, "TEXTS", 20)
    rows = {(r["qid"], r["task"]): r["score"] for r in lookup.best_examples(*frames, list("abc")).collect()}
    assert rows == pytest.approx(brute_best(queries, examples, "abc"))


def test_merged_sketches_equal_one_pass(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("p"), F.col("id") % 20_000).alias("patch_id"), (F.col("id") % 7_000).alias("key"),
        F.element_at(F.array(F.lit("train"), F.lit("test")), (F.col("id") % 2 + 1).cast("int")).alias("split"), F.lit("AT").alias("country"))
    numbered = rows.coalesce(1).withColumn("id", F.monotonically_increasing_id())
    halves = [dataset.sketches(numbered.where(c)) for c in ("id < 25000", "id >= 25000")]
    flat = lambda kept: sorted(map(tuple, dataset.distinct_counts(kept).collect()))
    once = flat(dataset.sketches(rows))
    assert flat(dataset.merged(*halves)) == once
    assert [r[:3] for r in once] == [("country", "AT", 60_000), ("split", "test", 30_000), ("split", "train", 30_000)]
    for (_, _, _, patches, keys), (want_patches, want_keys) in zip(once, [(20_000, 7_000), (10_000, 3_500), (10_000, 3_500)]):
        assert abs(patches / want_patches - 1) < 0.07 and abs(keys / want_keys - 1) < 0.07
