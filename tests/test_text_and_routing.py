"""Text metrics, routing and contracts on hand-checked cases."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import text
from geoquarry.operators import catalog, dataset, evaluate, kernels, routing, trace
from geoquarry.plans.templates import TRACES


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_matches_the_table_method():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in "ab")
        assert kernels.lcs_length(a, b) == slow_lcs(a, b)


def test_overlap_counts_few_tokens_at_once(spark, monkeypatch):
    """A batch of many long texts used to be counted as one, whatever its size."""
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    sides = [(words(n), words(n // 2)) for n in [0, 30, 1, 400, 7, 7, 7, 120, 0]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sides))), *[pa.array([s[k] for s in sides], pa.list_(pa.string())) for k in (0, 1)]], names=["id", "ref", "cand"])
    monkeypatch.setattr(evaluate, "_TOKENS", 40)
    runs = list(evaluate._runs(batch))
    assert pa.Table.from_batches(runs).to_pylist() == batch.to_pylist()
    sizes = [[len(row["ref"]) + len(row["cand"]) for row in run.to_pylist()] for run in runs]
    assert all(len(s) == 1 or sum(s) <= 40 for s in sizes) and any(len(s) > 1 for s in sizes)
    assert list(evaluate._runs(batch.slice(0, 0))) == []
    # more tokens than one count takes, in one task
    many = [(i, a * 60, b * 60) for i, (a, b) in enumerate(sides * 8)]
    rows = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, a, b in many], "id long, ref string, cand string").coalesce(1)
    got = {r["id"]: r for r in evaluate.overlap(rows, 1, with_lcs=True).collect()}
    assert len(got) == len(many)
    for i, a, b in many:
        assert (got[i]["n_ref"], got[i]["n_cand"], got[i]["lcs"]) == (len(a), len(b), kernels.lcs_length(a, b))
        assert got[i]["dot"] == sum(a.count(w) * b.count(w) for w in set(a))


def slow_bleu(r, c, n_max=4):
    if not r or not c:
        return 0.0
    shares = []
    for n in range(1, n_max + 1):
        grams = [tuple(c[i:i + n]) for i in range(len(c) - n + 1)]
        known = {tuple(r[i:i + n]) for i in range(len(r) - n + 1)}
        shares.append(sum(g in known for g in grams) / len(grams) if grams else 1.0)
    if 0.0 in shares:
        return 0.0
    penalty = 1.0 if len(c) > len(r) else 2.718281828 ** (1 - len(r) / len(c))
    return min(1.0, penalty * sum(s ** (1 / n_max) for s in shares) / n_max)


def test_text_metrics_on_small_pairs(spark):
    rng = random.Random(2)
    words = "the red roof near a wide river bank".split()
    pairs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)]
    pairs += [(60, "", "x"), (61, "A  b, C d E", "a B c! d e"), (62, "yes", "yes")]
    frame = spark.createDataFrame(pairs, "id int, ref string, cand string")
    got = {r["id"]: r for r in evaluate.bleu_ref(frame).join(evaluate.rouge_l(frame), "id").join(evaluate.cider_proxy(frame), "id").collect()}
    for i, ref, cand in pairs:
        r, c = (t.lower().replace(",", "").replace("!", "").split() for t in (ref, cand))
        assert got[i]["bleu"] == pytest.approx(slow_bleu(r, c))
        common = slow_lcs(r, c)
        assert got[i]["rouge_l"] == pytest.approx(2 * common / (len(r) + len(c)) if r and c and common else 0.0)
        dot = sum(r.count(w) * c.count(w) for w in set(r))
        size = math.sqrt(sum(r.count(w) ** 2 for w in set(r))) * math.sqrt(sum(c.count(w) ** 2 for w in set(c)))
        assert got[i]["cider_proxy"] == pytest.approx(dot / size if size else 0.0)


def test_answer_scores(spark):
    rows = [("Yes", "yes", "presence"), ("no buildings to the north", "no", "comp"), ("north", "no", "comp"), ("12", "12", "count"),
            ("rural area", "rural", "rural_urban"), ("", "3", "count")]
    got = evaluate.score_pairs(spark.createDataFrame(rows, "prediction string, gold string, type string")).collect()
    assert [r["answer_match"] for r in got] == [True, True, False, True, True, False]
    assert [r["raw_match"] for r in got] == [False, False, False, True, False, False]
    assert [r["norm_match"] for r in got][:2] == [True, False]


def test_word_boundaries(spark):
    rows = [("no", "cannot say, north"), ("no", "there is no lake"), ("0_to_10", "about 0 to 10 percent"), ("a.b", "axb"), ("a.b", "x a_b a.b")]
    got = spark.createDataFrame(rows, "g string, r string").select(text.contains_answer(F.col("g"), F.col("r")).alias("c")).collect()
    assert [r["c"] for r in got] == [False, True, True, False, True]


QUERIES = [
    ("Use SAR and optical images together", "fusion"), ("What changed here?", "change"), ("Highlight the lake", "grounding"),
    ("Describe the scene", "caption"), ("How many roofs?", "vqa"), ("HAS IT GROWN since the first survey: grown since 2001", "change"),
    ("Which crop is being grown here", "vqa"), ("where's the bridge", "grounding"), ("  compare these two images  ", "change"),
    ("summarise", "vqa"), ("", "vqa"), ("merge sar layers information flooded", "fusion"),
]


def test_routes(spark):
    rows = [(i, q, 2) for i, (q, _) in enumerate(QUERIES)]
    got = routing.route(spark.createDataFrame(rows, "qid int, query string, n_inputs int")).orderBy("qid").collect()
    assert [r["task"] for r in got] == [t for _, t in QUERIES]
    assert got[0]["mechanism"] == "rule" and got[0]["matched"] == "fusion_sar_optical"
    assert got[10]["matched"] == "default:vqa_fallback" and got[10]["alternatives"] == []
    assert got[11]["matched"] == "exemplar:fusion" and got[11]["score"] >= 0.22 and got[11]["exemplar"]
    assert len(got[11]["alternatives"]) == 3


def test_repeated_words_weigh_once_per_occurrence(spark):
    rows = [(0, "reservoir reservoir exactly", 1)]
    got = routing.exemplar_matches(spark.createDataFrame(rows, "qid int, query string, n_inputs int")).collect()
    w = routing.IDF
    q = {"reservoir": 2 * w["reservoir"], "exactly": w["exactly"]}
    dot = w["reservoir"] * q["reservoir"] + w["exactly"] * q["exactly"]
    size = math.sqrt(sum(v * v for v in q.values())) * math.sqrt(w["reservoir"] ** 2 + w["exactly"] ** 2)
    best = max(got, key=lambda r: r["score"])
    assert best["text"] == "where exactly is the reservoir" and best["score"] == pytest.approx(dot / size)


def test_targets(spark):
    rows = [("Highlight the water body referred to in the query.", "water body"), ("Where is the river?", "river"),
            ("show me where the forest is", "forest"), ("x", "x")]
    got = spark.createDataFrame(rows, "q string, want string").select(routing.grounding_target(F.col("q")).alias("t"), "want").collect()
    assert [r["t"] for r in got] == [r["want"] for r in got]


def test_modality_cases(spark):
    rows = [
        ("/x/scene.tif", 3, None, {}, "optical", "band_count"), ("/x/scene.tif", 2, None, {}, "unknown", "band_count"),
        ("/x/S1_VV.tif", 2, None, {}, "sar", "filename"), ("/x/rgb.png", 3, None, {"k": "backscatter"}, "unknown", "metadata"),
        ("/x/rgb.png", 3, None, {"k": "Optical"}, "optical", "metadata"), ("/sar/scene.tif", 12, None, {}, "msi", "band_count"),
        ("/x/rgb.png", 3, " Msi ", {}, "msi", "user"), ("/x/rgb.png", 3, "lidar", {}, None, "error"),
    ]
    frame = spark.createDataFrame(
        [(i, p, n, u, t) for i, (p, n, u, t, _, _) in enumerate(rows)],
        "scene int, path string, band_count int, user_modality string, tags map<string,string>")
    got = catalog.resolve_modality(frame).orderBy("scene").collect()
    assert [(r["decision"]["modality"], r["decision"]["mechanism"]) for r in got] == [(m, k) for *_, m, k in rows]
    odd = spark.createDataFrame([(0, "/x/sar_7.tif", 7, None, {})], frame.schema)
    r = catalog.guard_modality(catalog.resolve_modality(odd)).first()
    assert r["modality"] == "unknown" and r["is_sar"]


def test_trace_contract(spark):
    good = TRACES[0].replace("{id}", "1").replace("{v}", "2.5")
    rows = [(good,), (good.replace('"shape": [8, 8]', '"shape": [8, 8, 8]'),), ("[]",), ("not json",), (good.replace('"adapter": null', '"adapter": 1'),)]
    got = [r["violations"] for r in trace.validate_traces(spark.createDataFrame(rows, "trace string")).collect()]
    assert got == [[], ["inputs[0].shape: must be ints2"], ["not a JSON object"], ["not a JSON object"], ["models_used[0].adapter: must be str?"]]


def test_pairing_drops_a_patch_with_a_missing_half(spark):
    rows = [(i, f"S2_{f2}_T_{i}_1", f"S1_{f1}_X_{i}_1", ["A"], "train", "AT") for i, (f2, f1) in enumerate(
        [("a", "a"), ("a", "c"), ("b", "b"), ("c", "a"), ("b", "c")])]
    patches = spark.createDataFrame(rows, "key long, patch_id string, s1_name string, labels array<string>, split string, country string")
    targets = dataset.pair_targets(patches, k=2)
    assert sorted(r["key"] for r in targets.select("key").collect()) == [0, 2]
    every = dataset.expected_files(targets)
    listing = every.where(~((F.col("key") == 2) & (F.col("side") == "S1")))
    got = {r["key"]: r for r in dataset.verify_pairs(targets, listing).collect()}
    assert got[0]["kept"] and not got[2]["kept"]
    assert (got[2]["missing_s2_bands"], got[2]["missing_s1_bands"]) == (0, 2)
    with pytest.raises(ValueError):
        dataset.split_rows(patches, "dev")


def test_seeded_subset_repeats(spark):
    rows = spark.range(500)
    draw = lambda: [r["id"] for r in evaluate.seeded_subset(rows, "id", 20).collect()]
    assert draw() == draw() and len(set(draw())) == 20
    assert evaluate.seeded_subset(rows, "id", 0).count() == 500


def test_grams_are_numbered_without_sorting(monkeypatch):
    import numpy as np

    from geoquarry.operators import evaluate, kernels

    assert evaluate._TOKENS <= 1 << 15
    monkeypatch.setattr(np, "unique", None)
    monkeypatch.setattr(np, "intersect1d", None)
    # "a b a" with "a a b", an empty reference with "c", and no tokens at all
    pair, side = np.array([0, 0, 0, 0, 0, 0, 1]), np.array([0, 0, 0, 1, 1, 1, 1])
    hits, clipped, total, products = kernels.gram_stats(pair, side, np.array([0, 1, 0, 0, 0, 1, 2]), 3, 3)
    assert total.tolist() == [[3, 2, 1], [1, 0, 0], [0, 0, 0]]
    assert hits.tolist() == [[3, 1, 0], [0, 0, 0], [0, 0, 0]]
    assert clipped.tolist() == [[3, 1, 0], [0, 0, 0], [0, 0, 0]]
    assert products.tolist() == [[5, 5, 5], [0, 0, 1], [0, 0, 0]]
