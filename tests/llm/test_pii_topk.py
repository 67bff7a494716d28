import random
import re

import numpy as np

from geoquarry.llm import pii, topk


def brute_spans(text):
    def checked(digits):
        d = [int(c) for c in digits][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and checked(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.+- ()9b0@._%é4") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("4111 1111 1111 1111", "1." * 40, "9" * 300, "a@b.c@d.e", "@" * 50 + "x@y.z"):
        assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_stay_linear():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "@" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" + " " * 400_000):
        pii.base_spans(text)


def contexts(spark):
    rows, rng = [], random.Random(5)
    for i in range(60):
        # most are addresses, some are written in a way that no base pattern knows
        who = f"user{i}@mail{i % 7}.example.org" if i % 3 else f"user{i}(at)mail{i % 7}"
        rows.append((i, f"some words here {rng.random()} please write to {who} before noon, version {i}.{i} of it"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_patterns_discover_what_the_base_misses(spark):
    docs = contexts(spark)
    rows = {r["doc_id"]: r for r in pii.extract(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, row in rows.items():
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[i])]
        assert [":".join(s) for s in spans][: len(base)] == base
        if i % 3 == 0:
            found = [texts[i][int(a) : int(b)] for k, a, b in spans if k == "like_email"]
            assert found == [f"user{i}(at)mail{i % 7}"]
        else:
            assert not any(k.startswith("like") for k, _, _ in spans)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "[like_email]" in masked[0] and "[email]" in masked[1] and "user" not in masked[0] + masked[1]


def test_pii_on_awkward_rows(tables):
    got = pii.extract(tables.odd).toPandas()
    assert len(got) == len(tables.rows)
    want = sorted(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")) for _, t, _, _ in tables.rows)
    assert sorted(got["spans"]) == want
    kept = pii.redact(tables.odd)
    assert kept.columns == tables.odd.columns and kept.count() == len(tables.rows)
    assert kept.where("text is null").count() == 2
    assert pii.extract(tables.empty).count() == 0 and pii.redact(tables.empty).count() == 0


def brute_top(ids, vectors, top, every):
    out = []
    for q in range(len(ids)):
        if ids[q] % every:
            continue
        score = vectors @ vectors[q]
        order = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != ids[q])[:top]
        out += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 24)) * rng.choice([0.2, 1, 3], (400, 1))
    x[50:60] = x[40]
    ids = rng.permutation(400)
    monkeypatch.setattr(topk, "TILE", 37)
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)]
    rows += [(900, None, "x"), (920, [1.0, None], "x"), (940, [float("nan")] * 24, "x"), (None, [1.0] * 24, "x"), (960, [], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    want = brute_top(ids, np.floor(64 * x).astype(np.int64), 20, 20)
    for blocks in ((8192, 1024), (60, 7)):
        monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
        monkeypatch.setattr(topk, "QUERIES", blocks[1])
        assert sorted(tuple(r) for r in topk.top_k(frame).collect()) == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_bounds_are_above_the_product():
    rng = np.random.default_rng(8)
    a, b = np.floor(rng.normal(0, 20, (50, 33))), np.floor(rng.normal(0, 20, (60, 33)))
    exact, last = a @ b.T, None
    for level in topk.LEVELS:
        bound = topk.segments(a, level) @ topk.segments(b, level).T
        assert (bound >= exact - 1e-6).all()
        last = bound
    assert (last - exact).mean() < (topk.segments(a, 1) @ topk.segments(b, 1).T - exact).mean()


def test_forms_discover_identifiers_that_the_base_passes_over(spark):
    rng = random.Random(11)

    def card(valid):
        while True:
            number = "".join(rng.choice("0123456789") for _ in range(16))
            if pii.luhn([int(c) for c in number]) == valid:
                return number

    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    text = lambda *inner: " ".join([*rng.sample(words, 6), *inner, *rng.sample(words, 6)])
    rows = [(i, text(card(True))) for i in range(30)]
    # two side by side are one run of 32 digits, a wrong check digit is no card to the base
    rows += [(100, text(card(True), card(True))), (101, text(card(False))), (102, text("2024", "12345678")), (103, text("1234567890123"))]
    found = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    spans = {i: [s.split(":") for s in (r["spans"] or "").split(",") if s.startswith("like_")] for i, r in found.items()}
    assert [texts[100][int(a) : int(b)] for _, a, b in spans[100]] == texts[100].split()[6:8]
    assert [texts[101][int(a) : int(b)] for _, a, b in spans[101]] == texts[101].split()[6:7]
    assert not spans[102] and not spans[103] and found[100]["n_card"] == 0
    assert all(not spans[i] and found[i]["n_card"] == 1 for i in range(30))
