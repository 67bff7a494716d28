"""Toxicity by compression distance."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from geoquarry.llm.common import fold_is, labelled_sample, table
from geoquarry.llm.quality_rules import calibrate

#: Window and step in bytes; bytes of each class's own dictionary part and of the common part; zstandard level.
WINDOW, STEP, OWN_BYTES, COMMON_BYTES, LEVEL = 96, 64, 1024, 8192, 8
#: Gains in bytes that windows are counted at, and the length of a summary.
REACHED = (2, 3, 4, 5, 6)
FEATURES = 2 + 2 * len(REACHED)
#: Most labelled documents learned from, of each label.
PER_CLASS = 1500
#: A word belongs to a class's own text if its document count there exceeds what the other class suggests by so many standard deviations.
DEVIATIONS = 3.5
HELD_OUT = (5, 0)
#: How often samples are repeated, until the trainer takes them.
TIMES = (1, 4, 16, 64, 256)
_WORD = re.compile(r"\w+")


def own_text(texts, others):
    """For each text, its words that are much more usual in ``texts`` than in ``others``."""
    sets = [(set(_WORD.findall(t)), t) for t in texts]
    here, there = Counter(), Counter()
    for words, _ in sets:
        here.update(words)
    for t in others:
        there.update(set(_WORD.findall(t)))
    scale = max(1, len(texts)) / max(1, len(others))
    own = {w for w, n in here.items() if n - scale * there[w] > DEVIATIONS * (n + scale * scale * there[w]) ** 0.5}
    return [" ".join(w for w in _WORD.findall(t) if w in own) for t in texts]


def dictionary(texts, size):
    """Content of a zstandard dictionary trained on ``texts``.

    The trainer wants more samples than a small class has, so samples are repeated
    until it takes them; nothing to learn from gives no content.
    """
    samples = []
    for t in texts:
        b = t.encode()
        samples += [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    for times in TIMES if samples else ():
        try:
            return zstandard.train_dictionary(min(size, max(256, total // 4)), samples * times).as_bytes()
        except (zstandard.ZstdError, ValueError):
            continue
    return b""


def compressors(pair):
    """One compressor for each dictionary content, taken as raw content: small windows then cost what they do not share with it."""
    out = []
    for content in pair:
        # fewer than 8 bytes are no dictionary
        data = zstandard.ZstdCompressionDict(content.rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def gains(text, pair):
    """For each window of the lower-cased whole text, how many bytes shorter the toxic dictionary makes it."""
    body = text.lower().encode("utf-8", "surrogatepass")
    first, second = pair[0].compress, pair[1].compress
    out = np.empty(max(1, -(-max(0, len(body) - WINDOW) // STEP) + 1), np.int16)
    for k in range(len(out)):
        window = body[k * STEP : k * STEP + WINDOW]
        out[k] = len(first(window)) - len(second(window))
    return out


def summary(gain):
    """What the windows say together: the largest gain, the mean of the three largest, and for each of a few gains how many windows reach it, also by length."""
    top = np.sort(gain)[-3:]
    reach = np.array([(gain >= g).sum() for g in REACHED], np.float64)
    return np.r_[top[-1], top.mean(), np.log1p(reach), np.sqrt(reach / len(gain))]


def train(sample):
    """Dictionaries and thresholds from pandas columns ``text``, ``label`` and, if known, ``weight`` (rows that a row stands for).

    Either dictionary is a common part, trained on ordinary text, and a part
    trained on what is usual in its class only.  Every third document is kept out of
    the dictionaries, and the gains of these calibrate a logistic curve over
    :func:`summary`; a probability of 0.5 is the threshold.
    """
    texts, labels = [t.lower() for t in sample["text"]], sample["label"].to_numpy()
    sides = [[t for t, y in zip(texts, labels) if y == v] for v in (0, 1)]
    if not sides[0] or not sides[1]:
        share = 0.02 if not sides[1] else 0.98
        return (b"", b""), np.r_[np.zeros(FEATURES), np.log(share / (1 - share))], np.zeros(FEATURES), np.ones(FEATURES)

    def fit(ordinary, toxic):
        common = dictionary(ordinary, COMMON_BYTES)
        # the common part stands last in both, so that what matches it costs the same in either
        return tuple(dictionary(own_text(*sides), OWN_BYTES) + b" " + common for sides in ((ordinary, toxic), (toxic, ordinary)))

    taught = [[t for i, t in enumerate(side) if i % 3] or side for side in sides]
    content = fit(*taught)
    pair, found, known = compressors(content), [], []
    for y, side in enumerate(sides):
        for t in side[::3]:
            found.append(summary(gains(t, pair)))
            known.append(y)
    x, y = np.array(found), np.array(known)
    middle, width = x.mean(0), x.std(0) + 1e-9
    theta = logistic((x - middle) / width, y)
    if "weight" in sample:
        # the sample has its classes in other shares than the labels
        real = [sample["weight"][labels == v].sum() for v in (0, 1)]
        theta[-1] += np.log(real[1] / real[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return content, theta, middle, width


def logistic(x, y, ridge=1.0, steps=100):
    """Weights and bias of a ridge-bound logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta)), x.T @ (p - y) + ridge * theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def probability(text, pair, model):
    _, theta, middle, width = model
    x = (summary(gains(text, pair)) - middle) / width
    return float(1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30))))


def score_toxicity(docs, model, id_col="doc_id", text_col="text"):
    """Probability of label 1 for each whole text: id, ``held_out``, ``score``, ``predicted``.

    A null or empty text is one empty window, which gains nothing; repeated rows
    agree; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches):
        pair = compressors(model[0])
        for batch in batches:
            scores = [probability(t.as_py() or "", pair, model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, f"doc_id {kind}, score double")
    return found.select("doc_id", fold_is("doc_id", *HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs, model, text_col="text"):
    """The rows of ``docs`` whose texts score below 0.5, unchanged."""
    place = docs.columns.index(text_col)

    def sift(batches):
        pair = compressors(model[0])
        for batch in batches:
            yield batch.filter(pa.array([probability(t.as_py() or "", pair, model) < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def trained(docs, labels):
    return train(labelled_sample(docs, labels, "toxic", HELD_OUT, PER_CLASS))


def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return score_toxicity(docs, trained(docs, table(spark, folder, "labels")))
