"""Scores of the learned models against their definitions written out."""

import math
import random

import numpy as np
import pandas as pd
import pytest
import zstandard

from geoquarry.llm import quality_model, toxicity


def some_texts():
    rng = random.Random(6)
    words = ["river", "stone", "idiot", "fool", "garden", "ä", "漢字", "walk"] + [f"w{i}" for i in range(60)]
    return ["", "x", "plain words only", "IDIOT fool"] + [" ".join(rng.choice(words) for _ in range(n)) for n in (9, 40, 300, 2500)]


def compressed(content, window):
    held = zstandard.ZstdCompressionDict(content.rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=held, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))


def written_out_toxicity(text, model):
    (ordinary, toxic), theta, middle, width = model
    body, gain, at = text.lower().encode(), [], 0
    while True:
        window = body[at : at + toxicity.WINDOW]
        gain.append(compressed(ordinary, window) - compressed(toxic, window))
        if at + toxicity.WINDOW >= len(body):
            break
        at += toxicity.STEP
    top = sorted(gain, reverse=True)[:3]
    reach = [sum(g >= r for g in gain) for r in toxicity.REACHED]
    x = [top[0], sum(top) / len(top), *(math.log1p(r) for r in reach), *(math.sqrt(r / len(gain)) for r in reach)]
    z = sum(t * (v - m) / w for t, v, m, w in zip(theta, x, middle, width)) + theta[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_are_those_of_every_window_compressed_alone(spark):
    rng = random.Random(2)
    calm = [" ".join(rng.choice(["river", "stone", "garden", "walk", "sun", "tree"]) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rude = [t + " idiot fool you moron " * rng.randint(1, 3) for t in calm[:30]]
    sample = pd.DataFrame({"text": calm + rude, "label": [0] * 60 + [1] * 30, "weight": [3.0] * 60 + [1.0] * 30})
    model = toxicity.train(sample)
    texts = some_texts()
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()
    for r in rows:
        want = written_out_toxicity(texts[r["doc_id"]], model)
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(want >= 0.5)
    assert len(rows) == len(texts)


def test_a_small_class_gets_a_trained_dictionary_too():
    few = ["you utter idiot fool"]
    assert len(toxicity.dictionary(few * 3, 1024)) > 0 and toxicity.dictionary([], 1024) == b"" and toxicity.dictionary([""], 1024) == b""


def written_out_quality(text, net):
    body = text.encode()
    starts = [0]
    while starts[-1] + quality_model.CHUNK < len(body):
        starts.append(starts[-1] + quality_model.HOP)
    best, total, places = [0.0] * quality_model.FILTERS, [0.0] * quality_model.FILTERS, 0
    for start in starts:
        chunk = body[start : start + quality_model.CHUNK].ljust(quality_model.CHUNK, b"\0")
        for at in range(0, quality_model.CHUNK - quality_model.WIDTH + 1, quality_model.STRIDE):
            seen = np.concatenate([net.embed[b] for b in chunk[at : at + quality_model.WIDTH]])
            places += 1
            for f in range(quality_model.FILTERS):
                a = max(0.0, float(seen @ net.filters[:, f]) + float(net.bias[f]))
                best[f], total[f] = max(best[f], a), total[f] + a
    pooled = np.array(best + [t / places for t in total])
    z = float(np.tanh(pooled @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]) + net.shift
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_those_of_every_filter_at_every_place(spark):
    net = quality_model.Network(3)
    net.shift = 0.25
    texts = [t for t in some_texts() if len(t) < 3000]
    rows = quality_model.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in rows:
        want = written_out_quality(texts[r["doc_id"]], net)
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["predicted"] == int(r["score"] >= quality_model.THRESHOLD)
    assert len(rows) == len(texts)
