"""Pruned rankings, indexed matches and labels chosen in the kernel, against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import change, embed


def plain_ranks(images, texts):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = {}
    for i, v in images.items():
        scores = {t: round(float(unit(v) @ unit(u)), 9) for t, u in texts.items()}
        best = max(scores.values())
        own = scores.get(i)
        rank = None if own is None else 1 + sum(s > own or (s == own and t < i) for t, s in scores.items() if t != i)
        out[i] = (rank, best)
    return out


@pytest.mark.parametrize("tile", [2048, 16])
def test_pruned_ranks_equal_all_products(spark, tile):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 4
    images = {i: middles[i % 12] + rng.normal(size=16) * 0.5 for i in range(240)}
    texts = {i: v + rng.normal(size=16) * (0.05 if i % 5 else 3.0) for i, v in images.items() if i % 17}
    texts |= {1000: np.zeros(16), 1001: images[3] * 2, 1002: -images[4]}
    images |= {2000: np.zeros(16), 1001: images[3]}
    frame = lambda rows: spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, v array<double>").repartition(3)
    rows = embed.pair_scores(frame(images), frame(texts), tile).collect()
    got = {r["id"]: (r["rank"], round(r["best_score"], 9)) for r in rows}
    want = plain_ranks(images, texts)
    assert len(rows) == len(images) and {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=2e-9) for i in want)
    assert {r["n"] for r in rows} == {len(texts)}
    # images whose own text is close need few of the others, where these fill several tiles
    near = [r["compared"] / r["n"] for r in rows if r["id"] % 5 and r["id"] % 17 and r["id"] < 240]
    assert np.mean(near) < 0.4 if tile == 16 else set(near) == {1.0}


def test_small_tiles_send_no_more(spark, monkeypatch):
    # tiles are what is multiplied at once; what travels is a block of them, and blocks are few
    n = np.random.default_rng(1).integers(1, 1500, 900)
    for tile in (16, 200, 2048):
        cut = embed._tiles(np.arange(900), n, tile, 64)
        assert cut["last"].max() <= embed.BLOCKS and (cut["size"] <= max(tile, n.max())).all() and (cut["size"] * cut["tiles"] >= n).all()
    # many blocks give the ranks of one
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(80)]
    images = spark.createDataFrame(rows, "id long, v array<double>")
    texts = spark.createDataFrame([(i, [x + float(rng.normal()) for x in v]) for i, v in rows if i % 9], "id long, v array<double>")
    monkeypatch.setattr(embed, "BLOCK_ROWS", 16)
    want = plain_ranks(*({i: np.array(v) for i, v in map(tuple, df.collect())} for df in (images, texts)))
    for tile in (4, 50):
        got = {r["id"]: (r["rank"], r["best_score"]) for r in embed.pair_scores(images, texts, tile).collect()}
        assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
        assert all(got[i][1] == pytest.approx(want[i][1], abs=2e-9) for i in want)
    assert embed.pair_scores(images, texts.where("id < 0")).count() == 0


def test_no_reachable_cell_is_left_out():
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    pivots, texts, images = unit(rng.normal(size=(6, 5))), unit(rng.normal(size=(400, 5))), unit(rng.normal(size=(50, 5)))
    cells = embed._cells(texts, pivots)
    for own in (-1.0, 0.0, 0.5, 0.95, 1.0):
        reach = embed.within_reach(images, np.full(50, own), pivots)
        assert all(reach[i, cells[t]] for i, t in zip(*np.nonzero((images @ texts.T).round(9) >= own)))


def keypoints(spark, seed, n, flips=None):
    rng = np.random.default_rng(seed)
    words = rng.integers(-(2**63), 2**63, (n, 4))
    if flips is not None:
        base, most = flips
        words = base.copy()
        for row in words:
            for bit in rng.choice(256, rng.integers(0, most), replace=False):
                row[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
    rows = [(int(i % 2), int(i), *map(int, w)) for i, w in enumerate(words)]
    return words, spark.createDataFrame(rows, "pair int, kp long, d0 long, d1 long, d2 long, d3 long")


def test_indexed_matches_are_the_good_ones_with_fewer_comparisons(spark):
    words, a = keypoints(spark, 1, 400)
    _, b = keypoints(spark, 2, 400, (words, 80))
    want = sorted(map(tuple, change.good_matches(change.match_descriptors(a, b)).collect()))
    got = sorted(map(tuple, change.match_near(a, b).select(*["pair", "kp0", "kp1", "distance"]).collect()))
    assert got == want and 50 < len(got) < 400
    compared = change.near_candidates(a, b).count()
    assert compared < 0.5 * 2 * 200 * 200
    with pytest.raises(ValueError, match="below 50"):
        change.match_near(a, b, limit=51)


def test_labels_chosen_in_the_kernel(spark, monkeypatch):
    rng = np.random.default_rng(6)
    emb = spark.createDataFrame([(i, [float(v) for v in rng.integers(-2, 3, 3)]) for i in range(60)], "vec_id long, e array<double>")
    classes = spark.createDataFrame([(f"c{i:02d}", [float(v) for v in rng.integers(-2, 3, 3)]) for i in range(23)], "name string, vec array<double>")
    flat = lambda df: sorted((r["vec_id"], r["rank"], r["label"], round(r["score"], 9)) for r in df.collect())
    want = flat(embed.top_labels(embed.label_scores(emb, classes)))
    assert flat(embed.best_labels(emb, classes)) == want and len(want) == 300
    monkeypatch.setattr(embed, "MAX_CLASSES", 4)
    monkeypatch.setattr(embed, "VECTOR_TILE", 16)
    assert flat(embed.best_labels(emb, classes)) == want
    assert embed.label_scores(emb, classes, top=2).count() <= 60 * 2 * 7
    assert embed.best_labels(emb, classes.limit(0)).count() == 0


def test_dates_side_by_side(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "a", -0.25), (1, 1, "b", 0.125), (2, 0, "a", 1.0)]
    long = spark.createDataFrame(rows, "pair int, date int, label string, score double")
    side = lambda d: long.where(F.col("date") == d).drop("date")
    flat = lambda df: sorted(map(tuple, df.select("pair", "label", "raw_t0", "raw_t1").collect()))
    assert flat(embed.dated_delta(long)) == flat(embed.class_delta(side(0), side(1)))


def newton(x, y, strength):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 1 / strength), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


@pytest.mark.parametrize("strength", [1.0, 100.0])
def test_probe_equals_a_newton_solver(spark, strength):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * np.array([1, 1, 5, 0.1, 1, 1])
    labels = [[c for c in (0, 1, 2) if rng.random() < 1 / (1 + np.exp(-2 * row[c] + c))] + [9] for row in x]
    rows = spark.createDataFrame([(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, labels))], "id long, e array<double>, labels array<int>").repartition(3)
    got = embed.linear_probe(rows, rows, [0, 1, 2, 7, 9], strength).toPandas()
    for c in (0, 1, 2):
        own = got[got["cls"] == c].sort_values("id")
        y = np.array([c in l for l in labels], float)
        w = newton(x, y, strength)
        np.testing.assert_allclose(own["score"], x @ w[:-1] + w[-1], atol=1e-3)
        assert (own["truth"] == y).all()
    assert (got[got["cls"].isin([7, 9])]["score"] == 0).all() and len(got) == 1500


def test_probe_without_training_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [0])], "id long, e array<double>, labels array<int>")
    assert {r["score"] for r in embed.linear_probe(rows.limit(0), rows, [0, 1]).collect()} == {0.0}
    assert embed.linear_probe(rows, rows.limit(0), [0, 1]).count() == 0


def test_trimmed_fit_recovers_a_transform_among_wrong_matches(spark):
    rng = np.random.default_rng(8)
    rows = []
    for pair, n in ((0, 200), (1, 40), (2, 1)):
        x, y = rng.uniform(0, 500, (2, n))
        u, v = 0.9 * x - 0.2 * y + 5 + rng.normal(size=n) * 0.1, 0.2 * x + 0.9 * y - 3 + rng.normal(size=n) * 0.1
        wrong = np.arange(n) < 0.3 * n if n > 1 else np.zeros(n, bool)
        u[wrong], v[wrong] = rng.uniform(0, 500, (2, wrong.sum()))
        rows += [(pair, *map(float, r)) for r in zip(x, y, u, v)]
    points = spark.createDataFrame(rows, "pair int, x double, y double, u double, v double")
    fits = {r["pair"]: r for r in change.fit_trimmed(points).collect()}
    for pair in (0, 1):
        np.testing.assert_allclose([fits[pair][c] for c in ("a", "b")], [0.9, 0.2], atol=2e-3)
        np.testing.assert_allclose([fits[pair][c] for c in ("tx", "ty")], [5, -3], atol=0.5)
    assert fits[0]["n"] == 125 and fits[2]["a"] is None
    plain = {r["pair"]: r for r in change.fit_similarity(points).collect()}
    assert abs(plain[0]["a"] - 0.9) > 0.05
