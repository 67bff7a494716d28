import zlib

import numpy as np
import pytest

from geoquarry.llm import language, quality_model, quality_rules, toxicity
from geoquarry.llm.common import labelled_sample, table


@pytest.fixture(scope="module")
def labelled(spark):
    """Labelled texts of the small tables; text, quality, toxic, doc_id, lang."""
    folder = "/root/testdata/sf0.1"
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").toPandas()


def held(ids, modulus, rest):
    return np.array([zlib.crc32(str(i).encode()) % modulus == rest for i in ids])


def test_sample_is_bounded_repeatable_and_never_held_out(spark, labelled):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    one, two = (labelled_sample(docs, labels, "quality", (5, 0), 50) for _ in range(2))
    assert one.equals(two) and one.groupby("label").size().tolist() == [50, 50]
    out = set(labelled["text"][held(labelled["doc_id"], 5, 0)].str.slice(0, 900))
    inside = set(labelled["text"][~held(labelled["doc_id"], 5, 0)].str.slice(0, 900))
    assert all(t[:900] in inside or t[:900] not in out for t in one["text"])
    nothing = labelled_sample(docs, labels.where("false"), "quality", (5, 0), 50)
    assert len(nothing) == 0


def sample(labelled, label, n):
    rows = labelled[~held(labelled["doc_id"], 5, 0)].rename(columns={label: "label"})
    return rows.sort_values("doc_id").groupby("label").head(n)[["text", "label"]].assign(text=lambda d: d["text"].str.slice(0, 6000))


def test_toxicity_on_held_out_documents(spark, labelled, tables):
    model = toxicity.train(sample(labelled, "toxic", 300))
    test = labelled[held(labelled["doc_id"], 5, 0)]
    pair = toxicity.compressors(model[0])
    # these labels are noisy; texts with none of the marked words are not told apart
    scores = np.array([toxicity.probability(t, pair, model) for t in test["text"].head(400)])
    toxic = test["toxic"].head(400).to_numpy()
    assert scores[toxic == 1].mean() > scores[toxic == 0].mean() + 0.2
    rows = toxicity.score_toxicity(tables.odd, model).toPandas()
    assert len(rows) == len(tables.rows) and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert toxicity.score_toxicity(tables.empty, model).count() == 0
    kept = toxicity.without_toxic(tables.odd, model)
    assert kept.columns == tables.odd.columns and kept.count() == (rows["predicted"] == 0).sum()


def test_windows_cover_the_whole_text():
    content = b"padding padding idiot moron worthless "
    pair = toxicity.compressors((b"ordinary ordinary ordinary", content))
    text = "ab cd ef " * 500
    assert toxicity.gains(text, pair).max() < toxicity.gains(text + "worthless moron idiot", pair).max()
    assert len(toxicity.gains("", pair)) == 1


def test_quality_network_learns_and_covers_the_text(labelled, tables):
    net = quality_model.train(sample(labelled, "quality", 250), rounds=4)
    test = labelled[held(labelled["doc_id"], 5, 0)].head(300)
    right = np.mean([(net.probability(t) >= 0.3) == y for t, y in zip(test["text"], test["quality"])])
    assert right > 0.85
    body = bytes(range(1, 200)) * 20
    parts = quality_model.chunks(body)
    assert parts.shape[0] * quality_model.HOP >= len(body) - quality_model.CHUNK
    assert bytes(parts[-1]).rstrip(b"\0").endswith(body[-50:])
    rows = quality_model.score_quality(tables.odd, net).toPandas()
    assert len(rows) == len(tables.rows) and rows["score"].between(0, 1).all()
    assert quality_model.score_quality(tables.empty, net).count() == 0


def test_network_gradients():
    net = quality_model.Network()
    bodies, labels, weights = [b"some bytes to learn from" * 9, b"###$$$ 000 ###" * 30], np.array([1.0, 0.0]), np.array([1.0, 0.7])

    def loss():
        z = np.array([float(net.head(net.pooled(b))[0]) for b in bodies])
        return float((weights * (np.log1p(np.exp(z)) - labels * z)).sum())

    got = net.gradients(bodies, labels, weights)
    for name in ("out", "hidden", "filters", "bias"):
        value = getattr(net, name)
        spot = tuple(0 for _ in value.shape)
        value[spot] += 1e-2
        up = loss()
        value[spot] -= 2e-2
        down = loss()
        value[spot] += 1e-2
        assert got[name][spot] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-3)


def test_one_class_only():
    import pandas as pd

    only = pd.DataFrame({"text": ["a b c"] * 3, "label": [1] * 3, "weight": [1.0] * 3})
    assert quality_model.train(only).probability("x") > 0.9
    assert toxicity.probability("x", toxicity.compressors(toxicity.train(only)[0]), toxicity.train(only)) > 0.9
    none = only.head(0)
    assert 0 <= quality_model.train(none).probability("x") <= 1
    assert quality_rules.train(none)[3] == 0.0


def test_languages(labelled, tables):
    rows = labelled.dropna(subset=["lang"])
    fold = held(rows["doc_id"], 4, 2)
    model = language.learn(rows[~fold].groupby("lang").head(80)[["text", "lang"]])
    assert model[0] == ["de", "en", "es", "fr"]
    test = rows[fold].head(300)
    right = np.mean([model[0][language.distances(t, model).argmin()] == g for t, g in zip(test["text"], test["lang"])])
    assert right > 0.97
    got = language.identify(tables.odd, model).toPandas()
    assert len(got) == len(tables.rows)
    assert (got[got["doc_id"].isin([3, 4, 6])]["lang_pred"] == "und").all() and got["score"].between(0, 1).all()
    assert language.identify(tables.empty, model).count() == 0
    assert set(language.identify(tables.odd, language.learn(rows.head(0)[["text", "lang"]])).toPandas()["lang_pred"]) == {"und"}


def brute_distance(text, profile, kept):
    from collections import Counter

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        w = f" {w} "
        grams.update(c for c in w if c != " ")
        for n in (2, 3):
            grams.update(w[i : i + n] for i in range(len(w) - n + 1))
    return grams


def test_gram_counts_equal_brute_force(monkeypatch):
    text = "Der Hund, die Katze; 12 Mäuse — und der Hund!"
    for part in (1 << 18, 7):
        monkeypatch.setattr(language, "_PART", part)
        keys, counts = language.gram_counts(text)
        names = {}
        for k, n in zip(keys.tolist(), counts.tolist()):
            s = ""
            while k:
                s, k = chr(k & 0x1FFFFF) + s, k >> 21
            names[s] = names.get(s, 0) + n
        assert names == dict(brute_distance(text, None, None))


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(3)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(inside)


def test_rule_counts_equal_brute_force(labelled, tables):
    model = quality_rules.train(sample(labelled, "quality", 120))
    got = quality_rules.apply_rules(tables.odd, model).toPandas()
    assert len(got) == len(tables.rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(brute_rules(t or "") for _, t, _, _ in tables.rows)
    assert sorted(tuple(r) for r in got[names].itertuples(index=False)) == want
    assert (got["base_failed"] == ((got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"]))).all()
    assert not (got["kept"] & got["base_failed"]).any()
    for text in labelled["text"].head(60):
        body, words, ids, _ = quality_rules.parsed(text)
        assert quality_rules.rule_counts(body, words, ids) == brute_rules(text)
    assert quality_rules.apply_rules(tables.empty, model).count() == 0
    test = labelled[held(labelled["doc_id"], 5, 0)].head(200)
    w, b, slope, shift = model
    z = [slope * (w[at] @ v + b) + shift for at, v in (quality_rules.features(*quality_rules.parsed(t)) for t in test["text"])]
    assert np.mean((np.array(z) >= 0) == test["quality"]) > 0.85


def test_quality_verdicts_do_not_depend_on_the_cap_of_a_class(labelled):
    # weighted rows count as so many rows
    scores, labels, weights = np.array([-2.0, -1, 0.5, 1, -0.5, 2]), np.array([0, 0, 0, 1, 1, 1]), np.array([1, 1, 1, 5, 5, 5])
    assert quality_rules.calibrate(scores, labels, weights) == pytest.approx(quality_rules.calibrate(scores.repeat(weights), labels.repeat(weights)))
    rows = labelled[~held(labelled["doc_id"], 5, 0)].rename(columns={"quality": "label"}).sort_values("doc_id")
    rows = rows[["text", "label"]].assign(text=rows["text"].str.slice(0, 1500))
    few = int((rows["label"] == 0).sum())
    full = rows.groupby("label").head(5 * few)
    capped = full.groupby("label").head(few).reset_index(drop=True)
    counts = full["label"].value_counts()
    capped["weight"] = capped["label"].map(counts) / capped.groupby("label")["label"].transform("count")
    assert (capped["label"] == 1).sum() == few and counts[1] > 4 * few
    test = [quality_rules.features(*quality_rules.parsed(t[:1500])) for t in labelled[held(labelled["doc_id"], 5, 0)]["text"].head(400)]
    (a, b) = (
        np.array([slope * (w[at] @ v + bias) + shift for at, v in test])
        for w, bias, slope, shift in (quality_rules.train(full.reset_index(drop=True)), quality_rules.train(capped))
    )
    share = (1 / (1 + np.exp(-a))).mean() - (1 / (1 + np.exp(-b))).mean()
    assert abs(share) < 0.02 and ((a >= 0) == (b >= 0)).mean() > 0.97
