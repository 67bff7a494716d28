"""Helpers for skewed data and the block kernels, against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import change, embed, grid, kernels, scale
from geoquarry.sources.blocks import to_blocks, to_pixels


def image_rows(images):
    return [(s, y, x, float(v)) for s, im in images.items() for y, line in enumerate(im) for x, v in enumerate(line)]


def as_blocks(spark, images, size):
    px = spark.createDataFrame(image_rows(images), "scene int, y int, x int, v double")
    return to_blocks(px, size, ("scene",))


def as_images(blocks, shape):
    out = collections.defaultdict(lambda: np.full(shape, np.nan))
    for r in to_pixels(blocks, keep=("scene",)).collect():
        out[r["scene"]][r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    return out


def test_join_facts_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = scale.join_facts(left, right, ["k"])
    assert got.count() == 1000 and got.where("v <> k * 2").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_match_sorted_totals(spark, descending):
    rng = np.random.default_rng(3)
    data = [(int(k), float(v), 1) for k, v in zip(rng.integers(0, 2, 3000), rng.integers(0, 400, 3000))]
    rows = scale.running_sums(spark.createDataFrame(data, "k int, v double, c int"), ["k"], "v", ["c"], descending).collect()
    for r in rows:
        ahead = (lambda v: v >= r["v"]) if descending else (lambda v: v <= r["v"])
        assert r["run_c"] == sum(1 for k, v, _ in data if k == r["k"] and ahead(v))


@pytest.mark.parametrize("big", [0, 10**6])
def test_quantiles_both_ways(spark, big):
    rng = np.random.default_rng(5)
    images = {0: rng.normal(size=(12, 12)), 1: np.full((12, 12), 2.0)}
    images[0][0, :3] = np.nan
    got = scale.block_quantiles(as_blocks(spark, images, 5), ["scene"], [0.02, 0.5, 0.98], big=big).collect()
    for r in got:
        values = images[r["scene"]][np.isfinite(images[r["scene"]])]
        assert r["n"] == len(values)
        np.testing.assert_allclose(r["q"], np.percentile(values, [2, 50, 98]), rtol=1e-9)


def test_global_rank(spark):
    words = [f"w{(i * 7919) % 1000:04d}" for i in range(3000)]
    got = {r["w"]: r["rank"] for r in scale.global_rank(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("size", [4, 5, 16])
def test_morphology_over_block_edges(spark, size):
    rng = np.random.default_rng(size)
    images = {s: (rng.random((16, 16)) > 0.4).astype(float) * 255 for s in range(2)}
    got = as_images(grid.morph(as_blocks(spark, images, size), size=size), (16, 16))
    for s, im in images.items():
        want = im
        for pick in (np.minimum, np.maximum, np.maximum, np.minimum):
            want = kernels.neighbourhood(want, np.ones_like(want, dtype=bool), pick)
        np.testing.assert_array_equal(got[s], want)


def flood(mask):
    seen, areas = np.zeros_like(mask, dtype=bool), []
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        stack, area = [start], 0
        seen[start] = True
        while stack:
            y, x = stack.pop()
            area += 1
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not seen[p]:
                        seen[p] = True
                        stack.append(p)
        areas.append(area)
    return sorted(areas)


def test_components_cross_blocks(spark):
    rng = np.random.default_rng(11)
    snake = np.zeros((16, 16))
    snake[::2, :] = 1
    snake[1::4, -1] = 1
    snake[3::4, 0] = 1
    images = {0: snake, 1: (rng.random((16, 16)) > 0.6).astype(float), 2: np.zeros((16, 16))}
    rows = grid.components(as_blocks(spark, images, 4)).collect()
    for s, im in images.items():
        assert sorted(r["area"] for r in rows if r["scene"] == s) == flood(im > 0)


def test_resampling_over_block_edges(spark):
    rng = np.random.default_rng(2)
    images = {0: rng.random((10, 10))}
    got = as_images(grid.resample_bilinear(as_blocks(spark, images, 4), 23, 17, ("scene",), size=4), (23, 17))[0]
    ys = np.clip((np.arange(23) + 0.5) * 10 / 23 - 0.5, 0, 9)
    xs = np.clip((np.arange(17) + 0.5) * 10 / 17 - 0.5, 0, 9)
    np.testing.assert_allclose(got, kernels.sample(images[0], ys, xs))


def test_known_change_is_found_and_only_there(spark):
    # matching maps levels into the first date's range, so the patch takes a level that exists there
    base = np.tile(40.0 + 3 * np.arange(32), (32, 1))
    moved = base.copy()
    moved[8:20, 0:12] = 133
    a = as_blocks(spark, {0: base}, 8).withColumnRenamed("data", "g0")
    b = as_blocks(spark, {0: moved}, 8).select("scene", "by", "bx", F.col("data").alias("g1"))
    pair = a.join(b, ["scene", "by", "bx"]).select(
        "scene", "by", "bx", "h", "w", F.col("g0").cast("array<int>").alias("g0"), F.col("g1").cast("array<int>").alias("g1"))
    mask = as_images(change.change_mask(pair, 8), (32, 32))[0] > 0
    inside = np.zeros_like(mask)
    inside[8:20, 0:12] = True
    assert (mask & inside).sum() >= 0.9 * inside.sum() and (mask & ~inside).sum() <= 0.02 * mask.size
    same = pair.withColumn("g1", F.col("g0"))
    assert np.nansum(as_images(change.change_mask(same, 8), (32, 32))[0]) == 0


def test_similarity_fit_recovers_the_transform(spark):
    rows = [(0, float(x), float(y), 0.8 * x - 0.3 * y + 4, 0.3 * x + 0.8 * y - 2) for x in range(5) for y in range(5)]
    fit = change.fit_similarity(spark.createDataFrame(rows, "pair int, x double, y double, u double, v double")).first()
    np.testing.assert_allclose([fit["a"], fit["b"], fit["tx"], fit["ty"]], [0.8, 0.3, 4, -2], atol=1e-9)
    one = spark.createDataFrame([(0, 1.0, 1.0, 2.0, 2.0)], "pair int, x double, y double, u double, v double")
    assert change.fit_similarity(one).first()["a"] is None


def test_keypoint_numbers_do_not_make_tiles(spark):
    """An image is cut by how many keypoints it has; numbers far apart used to make a tile for each number between."""
    rows = lambda seed: [(p, (p << 50) + k, *[int(v) for v in np.random.default_rng(seed + 7 * p + k).integers(0, 2**20, 4)]) for p in range(4) for k in range(3 + 4 * p)]
    schema = "pair int, kp long, d0 long, d1 long, d2 long, d3 long"
    first, second = rows(1), rows(90)
    bits = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(a[2:], b[2:]))
    nearest = lambda row, others: min((bits(row, o), o[1]) for o in others if o[0] == row[0])
    want = []
    for a in first:
        far, other = nearest(a, second)
        b = next(o for o in second if o[1] == other)
        if nearest(b, first)[1] == a[1]:
            want.append((a[0], a[1], other, far))
    frames = [spark.createDataFrame(r, schema) for r in (first, second)]
    for tile in (2500, 4):
        assert sorted(map(tuple, change.match_descriptors(*frames, tile=tile).select("pair", "kp0", "kp1", "distance").collect())) == sorted(want)


def test_tiles_do_not_change_matches_or_ranks(spark):
    rng = np.random.default_rng(9)
    rows = lambda seed: [(0, i, *[int(v) for v in np.random.default_rng(seed + i).integers(0, 2**20, 4)]) for i in range(60)]
    schema = "pair int, kp long, d0 long, d1 long, d2 long, d3 long"
    a, b = spark.createDataFrame(rows(1), schema), spark.createDataFrame(rows(20), schema)
    whole = sorted(map(tuple, change.match_descriptors(a, b).collect()))
    assert whole and whole == sorted(map(tuple, change.match_descriptors(a, b, tile=7).collect()))
    vectors = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(50)]
    images = spark.createDataFrame(vectors, "id long, v array<double>")
    texts = spark.createDataFrame([(i, [x + 0.3 for x in v]) for i, v in vectors], "id long, v array<double>")
    # with smaller tiles fewer texts are compared
    ranks = lambda **kw: sorted(map(tuple, embed.pair_scores(images, texts, **kw).drop("compared").collect()))
    assert ranks() == ranks(tile=8)


def test_large_class_table_is_tiled(spark, monkeypatch):
    rng = np.random.default_rng(6)
    emb = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(20)], "vec_id long, e array<double>")
    classes = spark.createDataFrame([(f"c{i}", [float(v) for v in rng.normal(size=4)]) for i in range(9)], "name string, vec array<double>")
    flat = lambda df: sorted((r["vec_id"], r["label"], round(r["score"], 9)) for r in df.collect())
    small = flat(embed.label_scores(emb, classes))
    monkeypatch.setattr(embed, "MAX_CLASSES", 4)
    assert flat(embed.label_scores(emb, classes)) == small


def test_every_scene_takes_part(spark):
    from geoquarry.plans import views

    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        known = {r["scene"] for r in views.scenes(spark, folder).select("scene").collect()}
        pairs = views.scene_pairs(spark, folder)
        named = {r["s"] for r in pairs.selectExpr("explode(array(scene0, scene1)) AS s").distinct().collect()}
        assert named == known
        asked = {r["scene"] for r in views.request_inputs(spark, folder).select("scene").distinct().collect()}
        assert known < asked and len(asked - known) == 3


def test_unpaired_image_is_a_miss(spark):
    from geoquarry.operators import embed

    images = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    ranks = embed.pair_scores(images, images.where("id < 2"))
    assert {r["id"]: r["rank"] for r in ranks.collect()} == {0: 1, 1: 1, 2: None}
    assert embed.recall_at_k(ranks).first()["r1"] == pytest.approx(2 / 3)


def test_blocks_off_the_grid_fail(spark):
    from geoquarry.operators import grid

    blocks = spark.createDataFrame([(0, 0, 16, 16, 16, [1.0] * 256)], "scene int, by int, bx int, h int, w int, data array<double>")
    with pytest.raises(Exception, match="not on a grid"):
        grid.resample_nearest(blocks, 4, 4).collect()
    with pytest.raises(Exception, match="not on a grid"):
        grid.morph(blocks).collect()


def test_reduction_sends_only_sampled_lines(spark):
    import numpy as np

    from geoquarry.operators import grid
    from geoquarry.sources.blocks import to_pixels

    def raster(side, size):
        values = np.arange(side * side, dtype=float).reshape(side, side) % 251
        rows = [
            (0, y, x, size, size, values[y : y + size, x : x + size].ravel().tolist())
            for y in range(0, side, size) for x in range(0, side, size)
        ]
        return values, spark.createDataFrame(rows, "scene int, by int, bx int, h int, w int, data array<double>")

    for side in (64, 320):
        values, blocks = raster(side, 16)
        got = {(r["y"], r["x"]): r["v"] for r in to_pixels(grid.resample_nearest(blocks, 8, 8, size=16), keep=("scene",)).collect()}
        at = [int(i * side / 8) for i in range(8)]
        assert got == {(y, x): values[at[y], at[x]] for y in range(8) for x in range(8)}
        smooth = {(r["y"], r["x"]): r["v"] for r in to_pixels(grid.resample_bilinear(blocks, 8, 8, ("scene",), 16), keep=("scene",)).collect()}
        place = [(i + 0.5) * side / 8 - 0.5 for i in range(8)]
        low, share = [int(p) for p in place], [p - int(p) for p in place]
        want = lambda y, x: sum(
            values[low[y] + a, low[x] + b] * (share[y] if a else 1 - share[y]) * (share[x] if b else 1 - share[x]) for a in (0, 1) for b in (0, 1)
        )
        assert all(smooth[y, x] == pytest.approx(want(y, x)) for y in range(8) for x in range(8))
