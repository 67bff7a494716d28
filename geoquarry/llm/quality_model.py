"""Quality by a byte-level convolutional network in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.llm.common import fold_is, labelled_sample, table

#: Numbers per byte, bytes a filter sees and moves on, filters, hidden units.
DEPTH, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 12, 4, 24, 16
#: Bytes of a chunk and how far the next one starts.
CHUNK, HOP = 512, 384
#: Most labelled documents learned from, of each label; probability that counts as good.
PER_CLASS, THRESHOLD = 1500, 0.3
HELD_OUT = (5, 0)
#: Chunks that go through the filters at once.
AT_ONCE = 128


def chunks(body):
    """Overlapping chunks that together cover all of ``body``: a uint8 matrix, short ends filled with zero bytes."""
    data = np.frombuffer(body, np.uint8)
    n = 1 if len(data) <= CHUNK else 1 + -(-(len(data) - CHUNK) // HOP)
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class Network:
    """Byte embedding, one convolution, maximum and mean over all places of all chunks, one hidden layer, one probability."""

    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed=5):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.embed = rng.normal(0, 0.5, (256, DEPTH)).astype(f32)
        self.filters = rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(f32)
        self.bias = np.zeros(FILTERS, f32)
        self.hidden = rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)).astype(f32)
        self.hidden_bias = np.zeros(HIDDEN, f32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(f32)
        self.out_bias = np.zeros(1, f32)
        self.shift = 0.0

    def weights(self):
        return {k: getattr(self, k) for k in self.NAMES}

    def patches(self, block):
        """(chunks, places, WIDTH) bytes under the filter at each place."""
        return np.lib.stride_tricks.sliding_window_view(block, WIDTH, axis=1)[:, ::STRIDE]

    def responses(self, block):
        seen = self.patches(block)
        x = self.embed[seen].reshape(-1, WIDTH * DEPTH)
        return x, np.maximum(x @ self.filters + self.bias, 0).reshape(*seen.shape[:2], FILTERS)

    def pooled(self, body):
        """Per filter the maximum and the mean response over the whole document, in bounded blocks of chunks."""
        parts = chunks(body)
        most, total, places = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
        for at in range(0, len(parts), AT_ONCE):
            _, a = self.responses(np.ascontiguousarray(parts[at : at + AT_ONCE]))
            a = a.reshape(-1, FILTERS)
            most = np.maximum(most, a.max(0))
            total += a.sum(0)
            places += len(a)
        return np.r_[most, total / places].astype(np.float32)

    def head(self, pooled):
        return np.tanh(pooled @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, text):
        z = float(self.head(self.pooled(text.encode("utf-8", "surrogatepass")))[0]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, bodies, labels, weights):
        """Gradients of the weighted log loss over a batch of documents."""
        g = {k: np.zeros_like(v) for k, v in self.weights().items()}
        for body, y, w in zip(bodies, labels, weights):
            block = np.ascontiguousarray(chunks(body))
            x, a = self.responses(block)
            flat = a.reshape(-1, FILTERS)
            top = flat.argmax(0)
            pooled = np.r_[flat[top, np.arange(FILTERS)], flat.mean(0)]
            h = np.tanh(pooled @ self.hidden + self.hidden_bias)
            p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -30, 30)))
            e = np.float32((p - y) * w)
            g["out"] += e * h
            g["out_bias"] += e
            dh = e * self.out * (1 - h * h)
            g["hidden"] += np.outer(pooled, dh)
            g["hidden_bias"] += dh
            dp = self.hidden @ dh
            da = np.broadcast_to(dp[FILTERS:] / len(flat), flat.shape).copy()
            da[top, np.arange(FILTERS)] += dp[:FILTERS]
            da *= flat > 0
            g["filters"] += x.T @ da
            g["bias"] += da.sum(0)
            dx = (da @ self.filters.T).reshape(-1, DEPTH)
            seen = self.patches(block).reshape(-1)
            for k in range(DEPTH):
                g["embed"][:, k] += np.bincount(seen, dx[:, k], 256).astype(np.float32)
        return g


def train(sample, rounds=6, batch=32, rate=0.01, seed=5):
    """Fit a :class:`Network` by Adam on pandas columns ``text``, ``label``, ``weight``.

    Every fifth document stays out of the fit; their scores set the shift that
    matches the mean probability to the labels' real shares.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = sample["label"].to_numpy(np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        net.out[:] = 0
        net.shift = 0.0 if len(labels) == 0 else 4.0 if labels[0] else -4.0
        return net
    bodies = [t.encode("utf-8", "surrogatepass") for t in sample["text"]]
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    taught = np.flatnonzero(np.arange(len(labels)) % 5 != 4)
    kept = np.setdiff1d(np.arange(len(labels)), taught)
    first = {k: np.zeros_like(v) for k, v in net.weights().items()}
    second = {k: np.zeros_like(v) for k, v in net.weights().items()}
    step, total = 0, rounds * -(-len(taught) // batch)
    for _ in range(rounds):
        order = rng.permutation(taught)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            g = net.gradients([bodies[i] for i in some], labels[some], weights[some])
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, v in net.weights().items():
                d = g[k] / len(some)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                v -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    calibrate(net, [bodies[i] for i in kept], labels[kept], sample["weight"].to_numpy()[kept] if "weight" in sample else np.ones(len(kept)))
    return net


def calibrate(net, bodies, labels, weights, steps=60):
    """Set the shift by bisection so that the weighted mean probability is the labels' weighted share."""
    z = np.array([net.head(net.pooled(b))[0] for b in bodies])
    if len(z) == 0:
        return
    share = float((weights * labels).sum() / weights.sum())
    low, high = -20.0, 20.0
    for _ in range(steps):
        net.shift = (low + high) / 2
        if (weights / (1 + np.exp(-np.clip(z + net.shift, -30, 30)))).sum() / weights.sum() < share:
            low = net.shift
        else:
            high = net.shift


def score_quality(docs, net, id_col="doc_id", text_col="text", threshold=THRESHOLD):
    """Probability of label 1 for each whole text: id, ``held_out``, ``score``, ``predicted``.

    A null or empty text is one chunk of zero bytes; repeated rows agree; an empty
    table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            scores = [float(net.probability(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", fold_is("doc_id", *HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op5_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    return score_quality(docs, train(labelled_sample(docs, table(spark, folder, "labels"), "quality", HELD_OUT, PER_CLASS)))
