import random

import numpy as np
import pyarrow as pa

from geoquarry.llm import similar


def brute_groups(texts):
    """First index of each text's group, by all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        k = (t or "").encode().lower().split()
        sets.append({tuple(k[i : i + 5]) for i in range(max(1, len(k) - 4))} if k else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or s and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, n_groups=12, copies=12):
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(14))
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 90, 300]))]
        for _ in range(copies):
            some = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                some[rng.randrange(len(some))] = rng.choice(words)
            texts.append(" ".join(some) + (" " + line if rng.random() < 0.5 else ""))
    return texts


def test_signatures_turn_down_no_similar_pair():
    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        whole = rng.integers(0, 2**64, n + 200, dtype=np.uint64)
        one = whole[:n]
        two = whole[int(rng.integers(0, 1 + n // 4)) : n + int(rng.integers(0, 1 + n // 4))]
        shared = len(np.intersect1d(one, two))
        ok = similar.may_be_similar(len(one), similar.parity(one).tobytes(), len(two), similar.parity(two).tobytes())
        if 5 * shared >= 4 * (len(one) + len(two) - shared):
            assert ok
        kept += ok
    assert kept < 2500
    strangers = [similar.parity(rng.integers(0, 2**64, 500, dtype=np.uint64)).tobytes() for _ in range(200)]
    assert not any(similar.may_be_similar(500, a, 500, b) for a, b in zip(strangers, strangers[1:]))


def test_groups_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts = [*edited(rng), "one two", "ONE  two", "one two three", None, "", " \n"]
    want = sorted(set(brute_groups(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for large, rows in ((512, 20_000), (2, 20)):
        monkeypatch.setattr(similar, "LARGE", large)
        monkeypatch.setattr(similar, "SAMPLE_ROWS", rows)
        assert sorted(r["doc_id"] for r in similar.representatives(docs).collect()) == want


def test_stage_reaches_every_similar_pair(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = sorted(rows[i]["doc_id"] for i in set(brute_groups([r["text"] for r in rows])))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, small).select("doc_id").collect()) == want


def test_awkward_rows(tables):
    kept = similar.representatives(tables.odd)
    assert kept.columns == tables.odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 5, 7, 7, 8, 9, 10]
    assert similar.representatives(tables.empty).count() == 0


def bucket_rows(sets):
    """Rows (key, n, node, pos, root, signature, first shingles) of the prefixes of unconnected sets, in buckets, as pairs_across reads them."""
    rows = []
    for node, s in enumerate(sets):
        order = similar.prefix(s, (np.empty(0, np.uint64), np.empty(0, np.int64))).view(np.int64)
        short = similar.folded(similar.parity(s), similar._PARITY // 8).view(np.int64).tolist()
        firsts = [int(order[k] if k < len(order) else order[0]) for k in range(len(similar._FIRST))]
        rows += [(int(key), len(s), node, pos, node, *short, *firsts) for pos, key in enumerate(order)]
    rows.sort()
    names = ["key", "n", "node", "pos", "root", *similar._WORDS, *similar._FIRST]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def test_a_pair_under_many_keys_is_given_once(monkeypatch):
    rng = np.random.default_rng(5)
    sets = []
    for size in (3, 30, 400, 1500):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        # about 0.65 to 0.9 of the shingles of two sets are common to both
        for share in np.linspace(0.02, 0.2, 12):
            sets.append(np.unique(np.where(rng.random(size) < share, rng.integers(0, 2**64, size, dtype=np.uint64), base)))
    alike = set()
    for a, one in enumerate(sets):
        for b in range(a):
            shared = len(np.intersect1d(one, sets[b]))
            if 5 * shared >= 4 * (len(one) + len(sets[b]) - shared):
                alike.add((b, a))
    assert len(alike) > 20
    batch = bucket_rows(sets)
    for large in (512, 2):
        monkeypatch.setattr(similar, "LARGE", large)
        for step in (len(batch), 37):
            parts = [batch.slice(at, step) for at in range(0, len(batch), step)]
            found = [pair for out in similar.pairs_across(iter(parts)) for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
            assert alike <= set(found)
            assert len(found) <= 1.05 * len(set(found))
            # sets of 1,500 shingles that are far from alike are told apart as well
            assert len(set(found)) < 2 * len(alike) + 60
