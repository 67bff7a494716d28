"""Overlap joins against every pair tested."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import boxes, catalog, spatial


def brute(rows):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if w > 0 and h > 0 and a[0] != b[0]:
                out[(min(a[0], b[0]), max(a[0], b[0]))] = w * h
    return out


def some_boxes(n, rng, spread=10.0):
    rows = []
    for i in range(n):
        x, y = rng.choice((rng.uniform(-spread, spread), rng.randint(-3, 3))), rng.uniform(-spread, spread)
        w, h = rng.choice(((0.3, 0.4), (1.0, 1.0), (spread * 2, 0.1), (0.001, 0.002), (64.0, 0.5)))
        rows.append((i, float(x), float(y), float(x + w), float(y + h)))
    return rows


SCHEMA = "id long, xmin double, ymin double, xmax double, ymax double"


@pytest.mark.parametrize("bound", [3, 20, 100_000])
def test_grid_join_finds_every_pair_once(spark, bound):
    rows = some_boxes(250, random.Random(bound))
    # a hot place: many equal left edges
    rows += [(1000 + i, 5.0, 5.0 + i * 0.01, 5.5, 5.3 + i * 0.01) for i in range(120)]
    odd = [(2000, None, 0.0, 1.0, 1.0), (2001, 0.0, 0.0, 0.0, 9.0), (2002, float("nan"), 0.0, 1.0, 1.0), (2003, -float("inf"), 0.0, 1.0, 1.0), (2004, 3.0, 3.0, 2.0, 4.0)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    got = [((r["a"], r["b"]), (r["right"] - r["left"]) * (r["top"] - r["bottom"])) for r in spatial.overlapping(frame, bound).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    assert all(want[k] == pytest.approx(v) for k, v in got)


def test_tasks_hold_about_twice_the_bound(spark, monkeypatch):
    # one group of 400 rows, all alike along x
    rows = [(7, i, float(i % 3), float(i), float(i % 3) + 2.5, i + 0.5, 0) for i in range(400)]
    frame = spark.createDataFrame(rows, "image_id long, id long, xmin double, ymin double, xmax double, ymax double, role int")
    inner = spatial._sweeper

    def counting(keys):
        run = inner(keys)

        def watched(batches):
            sizes = collections.Counter()
            for batch in batches:
                sizes.update(zip(*(batch.column(c).to_pylist() for c in ("strip", "block"))))
                if max(sizes.values(), default=0) > 101:
                    raise ValueError("a group beyond its bound")
                yield batch

        return lambda batches: run(watched(batches))

    monkeypatch.setattr(spatial, "_sweeper", counting)
    assert spatial.sweep_pairs(frame, ["image_id"], 50).count() == 0
    tall = frame.withColumns({"ymin": F.lit(0.0), "ymax": F.lit(1.0)})
    assert spatial.sweep_pairs(tall, ["image_id"], 50).count() == 400 * 399 // 2


def test_corners_are_worked_out_once_a_pass(spark):
    # with no crowded key there are two passes: one counts, one sweeps
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def given(x):
        calls.add(1)
        return x

    rows = [(k % 10, k, float(k), 0.0, float(k) + 25.0, 1.0, 0) for k in range(40)]
    frame = spark.createDataFrame(rows, "image_id long, id long, xmin double, ymin double, xmax double, ymax double, role int")
    got = spatial.sweep_pairs(frame.withColumn("xmin", given("xmin")), ["image_id"]).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((k, k + d) for k in range(40) for d in (10, 20) if k + d < 40)
    assert calls.value <= 2 * len(rows)


def test_candidates_are_those_that_meet_along_x():
    rng = np.random.default_rng(2)
    n = 300
    group = np.sort(rng.integers(0, 6, n))
    xmin = rng.integers(0, 40, n).astype(float)
    order = np.lexsort((xmin, group))
    group, xmin = group[order], xmin[order]
    xmax = xmin + rng.integers(1, 9, n)
    home, role = rng.integers(0, 2, n), rng.integers(0, 2, n)
    got = [tuple(sorted(p)) for i, j in spatial.candidates(group, xmin, xmax, home, role) for p in zip(i.tolist(), j.tolist())]
    want = {
        (i, j) for i in range(n) for j in range(i + 1, n)
        if group[i] == group[j] and xmin[i] < xmax[j] and xmin[j] < xmax[i] and (home[i] or home[j]) and not (role[i] and role[j])
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_boxes_of_one_image_with_their_iou(spark):
    rng = random.Random(8)
    rows = []
    for image in (1, 2, None):
        for k, (_, *c) in enumerate(some_boxes(40, rng, 2.0)):
            rows.append((image, k, 0, *c))
    frame = spark.createDataFrame(rows, "image_id long, ord int, item int, xmin double, ymin double, xmax double, ymax double")
    got = {(r["image_id"], r["a"]["ord"], r["b"]["ord"]): r["iou"] for r in boxes.overlapping_boxes(frame, 15).collect() if r["image_id"]}
    want = {}
    for image in (1, 2):
        own = [(r[1], *r[3:]) for r in rows if r[0] == image]
        area = {r[0]: (r[3] - r[1]) * (r[4] - r[2]) for r in own}
        want |= {(image, a, b): s / (area[a] + area[b] - s) for (a, b), s in brute(own).items()}
    assert got == pytest.approx(want)


def test_no_footprints_no_pairs(spark):
    empty = spark.createDataFrame([], "id long, west double, south double, east double, north double")
    assert catalog.overlapping_footprints(empty).count() == 0
    one = empty.union(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 1.0, 1.0)], empty.schema))
    assert catalog.overlapping_footprints(one).where(F.col("a") == F.col("b")).count() == 0
