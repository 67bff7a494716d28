import hashlib
import random

import numpy as np
import pytest
import xxhash

from geoquarry.llm import graph, repeats, simhash


def brute_repeats(rows):
    """(id, bytes) -> per row (bytes, removed, runs, hash of the rest)."""
    least = {}
    for i, body in rows:
        if i is not None:
            for p in range(len(body) - 49):
                s = body[p : p + 50]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, body in rows:
        gone = np.zeros(len(body), bool)
        if i is not None:
            for p in range(len(body) - 49):
                if least[body[p : p + 50]] < i:
                    gone[p : p + 50] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        rest = bytes(np.frombuffer(body, np.uint8)[~gone])
        out.append((len(body), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcde fgh") for _ in range(rng.choice([48, 49, 50, 51, 120, 400]))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("ijklm nopq") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("zé") + text[at + 1 :]
        rows.append((rng.choice([i, i, i, 7]), text))
    # a text that is one letter over and over, and many copies
    return [*rows, (70, "a" * 700), (71, "a" * 300), (72, "ab" * 200), *[(80 + i, shared[5]) for i in range(40)], (None, shared[5]), (130, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = passages(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string").repartition(4)
    got = sorted(map(repr, (tuple(r) for r in repeats.remove_repeats(docs).collect())))
    want = sorted(repr((i, *x)) for (i, _), x in zip(rows, brute_repeats([(i, (t or "").encode()) for i, t in rows])))
    assert got == want


def test_repeats_in_small_pieces_and_awkward_rows(spark, tables, monkeypatch):
    want = sorted(repr(tuple(x)) for x in brute_repeats([(i, (t or "").encode()) for i, t, _, _ in tables.rows if i != 5]))
    docs = tables.odd.where("doc_id is null or doc_id <> 5")
    got = repeats.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert repeats.remove_repeats(tables.empty).count() == 0
    whole = next(r for r in repeats.remove_repeats(tables.odd).collect() if r["doc_id"] == 5)
    assert whole["n_removed"] == 0 and whole["n_bytes"] == len(tables.rows[5][1])


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    body = bytes(range(256)) * 3
    seen = []
    for buffer, rows, starts, lengths in repeats.pieces([(0, body), (1, b"x" * 49), (2, b"y" * 50)]):
        at = 0
        for row, start, n in zip(rows, starts, lengths):
            seen += [(row, start + k) for k in range(n - 49)]
            assert row != 0 or bytes(buffer[at : at + n]) == body[start : start + n]
            at += n
    assert sorted(seen) == [(0, p) for p in range(len(body) - 49)] + [(2, 0)]


def brute_print(text, words=3):
    tokens = [w for w in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_its_definition(tables):
    for _, text, _, _ in tables.rows:
        if text is None or len(text) < 6000:
            assert simhash.fingerprint(text or "") == brute_print(text or "")


def test_native_hash_is_the_same_function(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] % 2**64 == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not differ & m for m in masks)


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_local_components_both_ways(monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(300)})
    want = brute_components(values, 2)
    array = np.array(values, np.uint64)
    assert simhash.local_components(array).tolist() == want
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    assert simhash.local_components(array).tolist() == want


def test_links_and_stars_give_the_brute_components(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(25)})
    # a long chain, one bit at a time
    values = sorted({*values, *[(1 << k) - 1 for k in range(1, 50)]})
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long").repartition(3)
    stars = {r["a"] % 2**64: r["b"] % 2**64 for r in graph.components(simhash.links(frame)).collect()}
    brute = brute_components(values, 2)
    groups = {}
    for v, r in zip(values, brute):
        groups.setdefault(r, set()).add(v)
    found = {}
    for v in values:
        found.setdefault(stars.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_near_duplicates_and_representatives_on_awkward_rows(tables):
    got = simhash.near_duplicates(tables.odd).toPandas()
    assert len(got) == len(tables.rows)
    fox = got[got["fp"] == got[got["doc_id"] == 1]["fp"].iloc[0]]
    assert len(fox) == 4 and (fox["component_id"] == 1).all()
    nothing = got[got["fp"] == 0]
    assert len(nothing) == 4 and (nothing["component_id"] == 3).all()
    kept = simhash.representatives(tables.odd)
    assert kept.columns == tables.odd.columns
    rows = kept.toPandas()
    assert sorted(rows["doc_id"].dropna()) == [1, 3, 5, 7, 7, 8, 9, 10] and len(rows) == 8
    assert simhash.near_duplicates(tables.empty).count() == 0 and simhash.representatives(tables.empty).count() == 0
