"""Quality rules: counted rules and a calibrated n-gram model."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.llm.bytegrams import gram_hashes
from geoquarry.llm.common import labelled_sample, table

#: Feature buckets (a power of two) of words and word pairs, and of character grams; lengths of the latter in bytes.
BUCKETS, GRAMS = 1 << 13, (2, 4)
#: Most labelled documents learned from, of each label.
PER_CLASS = 1500
#: The fixed thresholds: fewest words, most percent of words in repeated windows, least calibrated probability.
MIN_WORDS, MAX_REPEATED, MIN_SCORE = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
_PART = 1 << 18


def repeated_words(ids):
    """How many words lie in a 3-word window that occurs twice or more; ``ids`` numbers the words."""
    n = len(ids) - 2
    if n < 2:
        return 0
    k = int(ids.max()) + 1
    keys = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1] * k + ids[2:]
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    start = (count > 1)[at]
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : shift + n] |= start
    return int(inside.sum())


def word_numbers(words):
    """Each word's number, in order of first use."""
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64), seen


def rule_counts(body, words, ids):
    """(words, characters in words, symbols, repeated lines, words in repeated windows) of UTF-8 ``body``."""
    lines = [x for x in body.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    # characters are the bytes that do not continue one
    packed = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((packed & 0xC0) != 0x80).sum())
    symbols = sum(body.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids)


def features(body, words, ids, seen):
    """Shares of hashed words, word pairs and byte grams: (bucket numbers, values), whole text, in bounded parts."""
    dense = np.zeros(3 * BUCKETS, np.float32)
    if words:
        own = np.array([_word_bucket(w) for w in seen], dtype=np.int64)
        spread = own[ids]
        dense[:BUCKETS] = np.bincount(own, np.bincount(ids, minlength=len(own)) / len(ids), BUCKETS)
        if len(ids) > 1:
            pairs = (spread[:-1] * 0x9E3779B1 + spread[1:]) & (BUCKETS - 1)
            dense[BUCKETS : 2 * BUCKETS] = np.bincount(pairs, minlength=BUCKETS) / len(pairs)
    data = np.frombuffer(body, np.uint8)
    for q in GRAMS:
        total = max(1, len(data) - q + 1)
        for at in range(0, total, _PART):
            h = gram_hashes(data[at : at + _PART + q - 1], q)
            dense[2 * BUCKETS :] += np.bincount((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS) / (total * len(GRAMS))
    at = np.flatnonzero(dense)
    return at, np.sqrt(dense[at])


def _word_bucket(word):
    return zlib.crc32(word) & (BUCKETS - 1)


def parsed(text):
    body = (text or "").encode()
    words = body.split()
    ids, seen = word_numbers(words)
    return body, words, ids, seen


def train(sample, rounds=6, rate=0.5, decay=1e-5, folds=3, seed=7):
    """Logistic regression on the hashed shares, then a calibration of its held-out scores.

    ``sample`` has ``text``, ``label`` and, if known, ``weight`` (rows that a row
    stands for).  Each class weighs the same in the fit; the calibration (a slope
    and a shift on the weighted scores of rows left out in turn) brings back the
    classes' real shares, also where the sample holds them in others.  Returns
    (weights, bias, slope, shift).  With one class only, the model gives that
    class's share.
    """
    labels = sample["label"].to_numpy()
    stands = sample["weight"].to_numpy(np.float64) if "weight" in sample else np.ones(len(labels))
    if len(labels) == 0 or labels.min() == labels.max():
        share = 0.5 if len(labels) == 0 else 0.98 if labels[0] else 0.02
        return np.zeros(3 * BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share)))
    rows = [features(*parsed(t)) for t in sample["text"]]
    rng = np.random.default_rng(seed)

    def fit(which):
        w, b, g = np.zeros(3 * BUCKETS, np.float32), 0.0, np.full(3 * BUCKETS, 1e-6, np.float32)
        share = np.bincount(labels[which], minlength=2) / len(which)
        for _ in range(rounds):
            for i in rng.permutation(which):
                at, value = rows[i]
                y = labels[i]
                p = 1 / (1 + np.exp(-np.clip(w[at] @ value + b, -30, 30)))
                error = (p - y) / (2 * max(share[y], 1e-9))
                step = error * value + decay * w[at]
                g[at] += step * step
                w[at] -= rate * step / np.sqrt(g[at])
                b -= 0.01 * error
        return w, b

    part = rng.permutation(len(labels)) % folds
    out = np.zeros(len(labels))
    for k in range(folds):
        inner = np.flatnonzero(part != k)
        if len(set(labels[inner])) < 2:
            continue
        w, b = fit(inner)
        for i in np.flatnonzero(part == k):
            out[i] = w[rows[i][0]] @ rows[i][1] + b
    slope, shift = calibrate(out, labels, stands)
    w, b = fit(np.arange(len(labels)))
    return w, b, slope, shift


def calibrate(scores, labels, weights=None, steps=200):
    """Slope and shift of a logistic curve from scores to labels, by Newton's method with a small ridge on the weighted loss."""
    x = np.c_[scores, np.ones(len(scores))]
    weights = np.ones(len(scores)) if weights is None else weights
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + 1e-2 * theta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


SCHEMA = (
    "doc_id {0}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def apply_rules(docs, model, id_col="doc_id", text_col="text", min_score=MIN_SCORE):
    """Rule counts and the model's verdict for each document, in one pass.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated
    windows.  ``kept``: not failed, and probability at least ``min_score``.  A
    null or empty text has no words and fails; repeated rows are judged alike; an
    empty table gives no rows; other columns are not read.
    """
    w, b, slope, shift = model

    def judge(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                body, words, ids, seen = parsed(text.as_py())
                counts = rule_counts(body, words, ids)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
                at, value = features(body, words, ids, seen)
                score = float(1 / (1 + np.exp(-np.clip(slope * (w[at] @ value + b) + shift, -30, 30))))
                rows.append((*counts, failed, not failed and score >= min_score, score))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    schema = SCHEMA.format(docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, schema)


def op10_quality_rules(spark, folder):
    docs = table(spark, folder, "documents")
    sample = labelled_sample(docs, table(spark, folder, "labels"), "quality", (5, 0), PER_CLASS)
    return apply_rules(docs, train(sample))
