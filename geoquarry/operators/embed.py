"""Embedding analytics: label scores, rankings, recall, probes, deltas, agreement
(J8, J17, J18, W2, W5, W9, W10, A13-A16, A24, L1, U1)."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.functions.text import fixed
from geoquarry.operators.scale import running_sums

#: Largest class table shipped to the tasks as one matrix; larger ones are tiled.
MAX_CLASSES = 4096
#: Vectors per tile of an all-pairs comparison.
VECTOR_TILE = 2048
#: Blocks that a side of an all-pairs comparison is cut into, from how many rows of one on, and the most numbers of a block.
BLOCKS, BLOCK_ROWS, BLOCK_NUMBERS = 8, 512, 1 << 23
#: A product of single precision is off by less, for unit vectors of up to thousands of numbers.
NARROW_SLACK = 1e-4
#: Scores closer than this are ties.
SCORE_DIGITS = 9
#: Pivots and rings of an all-pairs comparison; angles beyond a bound by less than the slack are not told apart.
PIVOTS, RINGS = 32, 32
RING, ANGLE_SLACK = math.pi / RINGS, 1e-6
TOP_LABELS = 5
TOP_MOVERS = 3


def _matrix(column):
    return np.stack(column.to_numpy()).astype(float)


def _unit_rows(m):
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def label_scores(emb, classes, id_col="vec_id", vec="e", top=None):
    """Cosine of every scene with every class (J17): (id, label, score).

    ``classes`` has ``name`` and ``vec``.  A class table within ``MAX_CLASSES``
    rows is checked and shipped as a matrix; a larger one meets the vectors
    chunk by chunk.  With ``top``, only the best labels of each vector and chunk
    leave the kernel.
    """
    kind = dict(emb.dtypes)[id_col]
    schema = f"{id_col} {kind}, label string, score double"
    head = classes.select("name", "vec").limit(MAX_CLASSES + 1).toPandas()
    if len(head) <= MAX_CLASSES:
        score = _scorer(head, id_col, vec, top)
        return emb.select(id_col, vec).mapInPandas(lambda batches: (score(b) for b in batches if len(b)), schema)
    # the chunks of a large table, each as large as a table that is shipped
    chunks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / MAX_CLASSES)).cast("int")
    size = classes.agg(chunks.alias("chunks"))
    right = classes.crossJoin(size).select("name", "vec", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int").alias("chunk"))
    # vectors meet a chunk in groups of bounded size
    groups = emb.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / VECTOR_TILE)).cast("int").alias("groups"))
    left = emb.select(id_col, vec).crossJoin(size).crossJoin(groups).select(
        id_col, vec, F.pmod(F.xxhash64(id_col), F.col("groups")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    tiles = right.crossJoin(groups).select("name", "vec", "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("tile"))

    def meet(a, b):
        return _scorer(b[["name", "vec"]], id_col, vec, top)(a) if len(a) and len(b) else pd.DataFrame(columns=[id_col, "label", "score"])

    return left.groupBy("tile", "chunk").cogroup(tiles.groupBy("tile", "chunk")).applyInPandas(meet, schema)


def _scorer(classes, id_col, vec, top):
    """Function from a frame of vectors to their scores with ``classes``, or to the ``top`` best of each."""
    classes = classes.sort_values("name")
    names = classes["name"].to_numpy()
    table = _unit_rows(_matrix(classes["vec"])) if len(classes) else np.zeros((0, 1))
    keep = len(names) if top is None else min(top, len(names))

    def score(frame):
        if not keep:
            return pd.DataFrame(columns=[id_col, "label", "score"])
        dots = _unit_rows(_matrix(frame[vec])) @ table.T
        # names are sorted, so a stable sort settles ties by name
        at = np.argsort(-dots.round(SCORE_DIGITS), axis=1, kind="stable")[:, :keep] if keep < len(names) else np.tile(np.arange(keep), (len(frame), 1))
        return pd.DataFrame({
            id_col: np.repeat(frame[id_col].to_numpy(), keep), "label": names[at].ravel(), "score": np.take_along_axis(dots, at, 1).ravel()})

    return score


def best_labels(emb, classes, k=TOP_LABELS, id_col="vec_id", vec="e"):
    """The ``k`` best labels of each scene (W2), chosen where they are scored; ties go to the label name."""
    return top_labels(label_scores(emb, classes, id_col, vec, top=k), k, id_col)


def top_labels(scores, k=TOP_LABELS, id_col="vec_id"):
    """The k best labels of each scene (W2); ties go to the label name."""
    order = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", SCORE_DIGITS)), "label")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pivots(vectors):
    """Unit vectors that texts are grouped around: the first PIVOTS by hash of the id, a bounded choice that changes no result."""
    rows = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    return _unit_rows(np.array([r["v"] for r in rows], dtype=float)) if rows else np.zeros((0, 1))


def _angles(unit, pivots):
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _cells(unit, pivots):
    """Cell of each vector: its nearest pivot and the ring of its angle to it; -1 for vectors without direction."""
    if not len(pivots) or not len(unit):
        return np.full(len(unit), -1)
    angle = _angles(unit, pivots)
    near = angle.argmin(1)
    ring = np.minimum((angle[np.arange(len(unit)), near] / RING).astype(int), RINGS - 1)
    return np.where((unit * unit).sum(1) > 0.5, near * RINGS + ring, -1)


def within_reach(unit, own, pivots):
    """Cells (rows x cells, the last one -1) that may hold a text with a score of ``own`` or more.

    By the triangle inequality a text of a ring is at least as far from a vector
    as the vector is from the ring.  Without an own score every cell is within reach.
    """
    most = np.arccos(np.clip(own - 2 * 10.0**-SCORE_DIGITS, -1.0, 1.0)) + ANGLE_SLACK
    edge = np.arange(RINGS) * RING
    angle = _angles(unit, pivots)[:, :, None]
    # the last ring reaches to the opposite pole
    outer = np.where(np.arange(RINGS) == RINGS - 1, np.pi, edge + RING)
    least = np.maximum(edge - angle, angle - outer).reshape(len(unit), -1)
    free = np.isnan(own) | ((unit * unit).sum(1) <= 0.5)
    near = (least <= most[:, None]) | free[:, None]
    return np.hstack([near, np.ones((len(unit), 1), bool)])


def pair_scores(images, texts, tile=VECTOR_TILE):
    """Compare every image with every text, reduced per image.

    ``images`` and ``texts`` have ``id`` and ``v``.  Per image: its own text's
    score, how many texts rank above it, the best text, and how many texts it
    was ``compared`` with.  An image without a text has no own score and no rank,
    which counts as a miss.

    Texts lie in cells, rings of angles around a few pivots; large cells are cut
    into tiles, small ones share one.  Tiles travel in blocks, and so do images: each pair
    of blocks meets in one task, where an image is multiplied only with the tiles
    of cells that may hold a score of at least its own, ``tile`` rows of each side
    at a time.  A vector is sent once for each block of the other side: a
    fixed number of times, until ``BLOCK_NUMBERS`` of a block ask for more.  Only
    per-image summaries are shuffled after that.
    """
    pivots = _pivots(texts)
    kinds = dict(images.dtypes)
    kind, arrays = kinds["id"], "array<double>"

    def place_texts(batches):
        for frame in batches:
            if len(frame):
                yield frame.assign(cell=_cells(_unit_rows(_matrix(frame["v"])), pivots))

    double = lambda c: F.col(c).cast(arrays).alias(c)
    placed = texts.select("id", double("v")).mapInPandas(place_texts, f"id {kind}, v {arrays}, cell int")
    # at most PIVOTS * RINGS + 1 cells
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).toPandas().sort_values("cell")
    tiles = _tiles(cells["cell"].to_numpy(), cells["n"].to_numpy(), tile, max(1, int(cells["d"].max())) if len(cells) else 1)
    parts, t_blocks = int(tiles["part"].max()) + 1 if len(tiles) else 1, int(tiles["last"].max()) + 1 if len(tiles) else 1
    codes = tiles["cell"].to_numpy()
    # the block of a tile by its place in the order of cells
    spans = texts.sparkSession.createDataFrame(tiles, "cell int, part int, tiles int, size long, start long, rows long, last int")
    tile_no = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    held = placed.join(F.broadcast(spans), "cell").select(
        "id", "v", "part", tile_no.alias("tile"), F.floor((F.col("start") + tile_no * F.col("size")) / F.col("rows")).cast("int").alias("t_block"))

    def place_images(batches):
        for frame in batches:
            for start in range(0, len(frame), 1024):
                yield placed_images(frame.iloc[start : start + 1024])

    def placed_images(frame):
        unit = _unit_rows(_matrix(frame["v"]))
        own = np.array([
            np.nan if t is None else float(np.dot(v, _unit_rows(np.asarray(t, dtype=float)[None, :])[0])) for v, t in zip(unit, frame["t"])
        ]).round(SCORE_DIGITS)
        # a cell's place, the last one for vectors without direction
        reach = within_reach(unit, own, pivots)[:, codes] if len(codes) else np.zeros((len(frame), 0), bool)
        first, last = (tiles["start"] // tiles["rows"]).to_numpy(), tiles["last"].to_numpy()
        asked = np.zeros((len(frame), t_blocks), bool)
        held = np.zeros((len(frame), parts), bool)
        for c, part in enumerate(tiles["part"]):
            asked[:, first[c] : last[c] + 1] |= reach[:, c, None]
            held[:, part] |= reach[:, c]
        return pd.DataFrame({
            "id": frame["id"], "v": frame["v"], "own": own, "t_blocks": [np.flatnonzero(a) for a in asked], "reach": [r.tobytes() for r in np.packbits(held, axis=1)]})

    mine = images.select("id", double("v")).join(texts.select("id", F.col("v").cast(arrays).alias("t")), "id", "left")
    size = images.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"))
    blocks = size.select(_block_count(F.col("n"), F.col("n") * F.coalesce("d", F.lit(1))).alias("i_blocks"))
    asking = mine.mapInPandas(place_images, f"id {kind}, v {arrays}, own double, t_blocks array<int>, reach binary").crossJoin(blocks).select(
        F.pmod(F.xxhash64("id", "v"), F.col("i_blocks")).cast("int").alias("i_block"), F.explode("t_blocks").alias("t_block"), "id", "v", "own", "reach")
    offered = held.crossJoin(blocks).select(
        F.explode(F.sequence(F.lit(0), F.col("i_blocks") - 1)).alias("i_block"), "t_block", "part", "tile", "id", "v")

    def compare(x, y):
        names = ["id", "own", "above", "best", "best_score", "compared"]
        if x.empty or y.empty:
            return pd.DataFrame(columns=names)
        y = y.sort_values(["part", "tile", "id"], kind="stable")
        ids, texts_ids, own = x["id"].to_numpy(), y["id"].to_numpy(), x["own"].to_numpy()
        a, b = _unit_rows(_matrix(x["v"])), _unit_rows(_matrix(y["v"]))
        reach = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in x["reach"]]), axis=1)
        part, number = y["part"].to_numpy(), y["tile"].to_numpy()
        cut = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1])) + 1, len(y)]
        above, compared = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        score, best = np.full(len(x), -np.inf), texts_ids[np.zeros(len(x), int)]
        narrow = a.astype(np.float32), b.astype(np.float32)
        for start, end in zip(cut[:-1], cut[1:]):
            rows = np.flatnonzero(reach[:, part[start]])
            compared[rows] += end - start
            paired = rows[~np.isnan(own[rows])]
            for of, known in ((paired, True), (np.setdiff1d(rows, paired, assume_unique=True), False)):
                for at in (of[i : i + tile] for i in range(0, len(of), tile)):
                    # what is well below the own score counts neither as better nor as best
                    near = ~(narrow[0][at] @ narrow[1][start:end].T < (own[at] - NARROW_SLACK).astype(np.float32)[:, None]) if known else None
                    if near is not None and np.count_nonzero(near) * 16 < near.size:
                        i, j = np.nonzero(near)
                        i, j = at[i], start + j
                        dots = np.einsum("ij,ij->i", a[i], b[j]).round(SCORE_DIGITS)
                        ahead = ((dots > own[i]) | ((dots == own[i]) & (texts_ids[j] < ids[i]))) & (texts_ids[j] != ids[i])
                        np.add.at(above, i[ahead], 1)
                        # the greatest of each row, and the first of these
                        order = np.lexsort((j, -np.where(np.isnan(dots), np.inf, dots), i))
                        i, j, dots = i[order], j[order], dots[order]
                        top = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                        at, found, with_ = i[top], dots[top], texts_ids[j[top]]
                    else:
                        dots = (a[at] @ b[start:end].T).round(SCORE_DIGITS)
                        other = texts_ids[None, start:end] != ids[at, None]
                        ahead = (dots > own[at, None]) | ((dots == own[at, None]) & (texts_ids[None, start:end] < ids[at, None]))
                        above[at] += (ahead & other).sum(axis=1)
                        top = dots.argmax(axis=1)
                        found, with_ = dots[np.arange(len(at)), top], texts_ids[start + top]
                    # no number counts as the greatest, as it does in an aggregate
                    new, old = (np.where(np.isnan(s), np.inf, s) for s in (found, score[at]))
                    better = (new > old) | ((new == old) & (with_ < best[at]))
                    score[at[better]], best[at[better]] = found[better], with_[better]
        seen = compared > 0
        return pd.DataFrame({"id": ids, "own": own, "above": above, "best": best, "best_score": score, "compared": compared})[names][seen]

    keys = ["i_block", "t_block"]
    parts_ = asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(
        compare, f"id {kind}, own double, above long, best {kind}, best_score double, compared long")
    best = F.max(F.struct("best_score", (-F.col("best")).alias("best")))
    whole = texts.agg(F.count(F.lit(1)).alias("n"))
    return parts_.groupBy("id").agg(
        F.first("own").alias("own"), F.sum("above").alias("above"), best.alias("b"), F.sum("compared").alias("compared")
    ).crossJoin(whole).withColumn("own", F.nanvl("own", F.lit(None).cast("double"))).select(
        "id", "own", F.when(F.col("own").isNotNull(), F.col("above") + 1).alias("rank"), (-F.col("b.best")).alias("best"),
        F.col("b.best_score").alias("best_score"), "n", "compared")


def _block_count(rows, numbers):
    """Blocks of a side: few, but one for every ``BLOCK_NUMBERS`` at least."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(rows / BLOCK_ROWS)), F.ceil(numbers / BLOCK_NUMBERS)).cast("int")


def _tiles(cells, n, tile, d):
    """The tiles of each cell and the blocks that hold them, from the cells' sizes.

    Small cells share a ``part`` of about ``tile`` rows, others are parts of their own, cut into ``tiles``
    of ``size`` rows.  A part begins at ``start``, and each ``rows`` rows are a block, up to block ``last`` for the cell.
    """
    small = n < tile
    before = np.cumsum(np.where(small, n, 0)) - np.where(small, n, 0)
    part = np.unique(np.where(small, -2 - before // tile, cells), return_inverse=True)[1]
    tiles = np.where(small, 1, -(-n // tile))
    size = -(-n // tiles)
    held = np.bincount(part, n).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    start = (np.cumsum(held) - held)[part]
    total = int(n.sum())
    blocks = max(1, min(BLOCKS, -(-total // BLOCK_ROWS)), -(-total * d // BLOCK_NUMBERS))
    rows = max(1, -(-total // blocks))
    return pd.DataFrame({"cell": cells, "part": part, "tiles": tiles, "size": size, "start": start, "rows": rows, "last": (start + (tiles - 1) * size) // rows})


def recall_at_k(ranks, ks=(1, 5)):
    """Share of images whose own text ranks within k; no rank is a miss."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"r{k}") for k in ks],
    )


def label_matrix(rows, classes, labels="labels"):
    """0/1 column per known class; unknown labels are ignored."""
    return rows.select(
        "*", *[F.array_contains(labels, c).cast("int").alias(f"is_{c}") for c in classes]
    )


def precision_points(scored):
    """Precision at each distinct score per class (W10): ties share one threshold.

    ``scored`` has ``cls``, ``score`` and ``truth`` (0/1).
    """
    runs = running_sums(scored.withColumns({"one": F.lit(1), "hit": F.col("truth")}), ["cls"], "score", ["one", "hit"], descending=True)
    return runs.select(
        "cls", "score", "one", "hit", (F.col("run_hit") / F.col("run_one")).alias("precision"), "run_hit", "run_one"
    )


def multilabel_metrics(scored):
    """Average precision and F1 (at score > 0) per class.

    Everything follows from the precision points, so the scores are read once.
    """
    said = F.col("score") > 0
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    sums = precision_points(scored).groupBy("cls").agg(
        F.sum(F.col("precision") * F.col("hit")).alias("_p"), F.sum("hit").alias("positives"),
        total(said, "hit").alias("tp"), total(said, "one").alias("said"),
    )
    # 2tp / (2tp + fp + fn), where tp + fp were said and tp + fn are positive
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("positives")), F.lit(0.0))
    return sums.select("cls", "positives", F.try_divide("_p", "positives").alias("ap"), f1.alias("f1"))


def macro(metrics):
    """mAP (classes without positives skipped) and macro F1."""
    return metrics.agg(F.avg("ap").alias("map"), F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def linear_probe(train, test, classes, strength=1.0, rounds=200, tolerance=1e-7):
    """One L2 logistic model per class on frozen vectors (A15): (id, cls, score, truth).

    ``train`` and ``test`` have ``id``, ``e`` and ``labels``.  A class with one
    kind of label in training scores 0.  All classes are fitted together
    (:func:`fit_probe`) and scored in one scan.
    """
    classes = list(classes)
    truths = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains("labels", c).cast("double"))
    rows = lambda df: df.select("id", F.col("e").cast("array<double>").alias("e"), F.coalesce(truths, F.array_repeat(F.lit(0.0), len(classes))).alias("y"))
    weights = fit_probe(rows(train).select("e", "y"), len(classes), strength, rounds, tolerance)
    kind = dict(test.dtypes)["id"]

    def score(batches):
        for frame in batches:
            if not len(frame):
                continue
            x = _matrix(frame["e"])
            scores = _augmented(x) @ weights.T if weights.shape[1] > 1 else np.zeros((len(x), len(classes)))
            yield pd.DataFrame({
                "id": np.repeat(frame["id"].to_numpy(), len(classes)), "cls": np.tile(np.arange(len(classes)), len(frame)),
                "score": scores.ravel(), "truth": _matrix(frame["y"]).ravel().astype(int)})

    found = rows(test).mapInPandas(score, f"id {kind}, cls int, score double, truth int")
    return found.withColumn("cls", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("cls") + 1))


def _augmented(x):
    return np.hstack([x, np.ones((len(x), 1))])


def fit_probe(rows, n_classes, strength=1.0, rounds=200, tolerance=1e-7):
    """Weights (classes x (dimension + 1), the intercept last) of logistic models with an L2 term of 1 / ``strength``.

    One L-BFGS for all classes in step: each pass over ``rows`` (``e``, ``y``) gives
    every class its loss and gradient at its own trial point.  The first pass
    also sums the products of the vectors, whose quarter bounds the curvature of every class;
    its inverse starts each class's steps, and where a step does not lower the loss a
    step by the bound alone does.  A pass sends one row of sums per task, added
    up by position, so the driver sees ``n_classes * (dimension + 2)`` numbers.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("e").isNotNull()).persist()
    first = rows.select(F.size("e").alias("d")).head()
    if first is None:
        return np.zeros((n_classes, 1))
    d = first["d"] + 1
    products = _summed(rows, lambda x, y: np.concatenate([(x.T @ x).ravel(), y.sum(0), [len(x)]]))
    n = products[-1]
    positives, gram = products[-1 - n_classes : -1], products[: d * d].reshape(d, d)
    ridge = np.r_[np.full(d - 1, 1.0 / strength), 0.0]
    bound = np.linalg.inv(gram / 4 + np.diag(ridge + 1e-12 * n))
    fitted = (positives > 0) & (positives < n)

    def look(w):
        held = spark.sparkContext.broadcast(w)

        def part(x, y):
            z = x @ held.value.T
            loss = (np.logaddexp(0.0, z) - y * z).sum(0)
            return np.concatenate([((0.5 * (1 + np.tanh(z / 2)) - y).T @ x).ravel(), loss])

        sums = _summed(rows, part)
        return sums[-n_classes:] + 0.5 * (ridge * w * w).sum(1), sums[:-n_classes].reshape(n_classes, d) + ridge * w

    at = np.zeros((n_classes, d))
    loss, slope = look(at)
    steps = [[] for _ in range(n_classes)]
    open_ = fitted.copy()
    for _ in range(rounds):
        open_ &= np.abs(slope).max(1) > tolerance * n
        if not open_.any():
            break
        move = np.zeros_like(at)
        for c in np.flatnonzero(open_):
            move[c] = -_two_loops(slope[c], steps[c], bound)
        new_loss, new_slope = look(at + move)
        worse = open_ & ~(new_loss <= loss + 1e-4 * (slope * move).sum(1))
        if worse.any():
            move[worse] = -slope[worse] @ bound
            new_loss, new_slope = look(at + move)
            for c in np.flatnonzero(worse):
                steps[c].clear()
        for c in np.flatnonzero(open_):
            change = new_slope[c] - slope[c]
            if change @ move[c] > 0:
                steps[c] = [*steps[c][-9:], (move[c].copy(), change)]
        at, loss, slope = at + move, new_loss, new_slope
    rows.unpersist()
    return np.where(fitted[:, None], at, 0.0)


def _two_loops(slope, steps, bound):
    """The L-BFGS direction from past (move, change of slope) pairs and a first inverse curvature."""
    q, past = slope.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        past.append(a)
    q = bound @ q
    for (s, y), a in zip(steps, reversed(past)):
        q += s * (a - (y @ q) / (s @ y))
    return q


def _summed(rows, part):
    """The sum of ``part(vectors with a one, truths)`` over all rows: per task first, then by position."""

    def run(batches):
        total = None
        for frame in batches:
            if len(frame):
                got = part(_augmented(_matrix(frame["e"])), _matrix(frame["y"]))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    parts = rows.mapInPandas(run, "sums array<double>").select(F.posexplode("sums").alias("at", "s"))
    # one row for each number of the result
    out = parts.groupBy("at").agg(F.sum("s").alias("s")).toPandas().sort_values("at")
    return out["s"].to_numpy()


def dated_delta(scores, keys=("pair",)):
    """Scores of two dates side by side, missing ones 0, from rows with their ``date`` 0 or 1.

    One pass over rows that are scored once; they are dealt by pair, so a window
    over the pair needs no further shuffle.
    """
    at = lambda d: F.coalesce(F.max(F.when(F.col("date") == d, F.col("score"))), F.lit(0.0)).alias(f"raw_t{d}")
    return scores.repartition(*keys).groupBy(*keys, "label").agg(at(0), at(1))


def class_delta(first, second, keys=("pair",)):
    """Scores of two dates side by side, missing ones 0."""
    keys = list(keys)
    a = first.select(*keys, "label", F.col("score").alias("raw_t0"))
    b = second.select(*keys, "label", F.col("score").alias("raw_t1"))
    return a.join(b, [*keys, "label"], "full_outer").na.fill(0.0, ["raw_t0", "raw_t1"])


def softmax_delta(joined, keys=("pair",)):
    """Each date's scores as percentages and their difference.

    A pair holds one row per class, so its window is as small as the vocabulary.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)

    def percent(c):
        e = F.exp(F.col(c) - F.max(c).over(whole))
        total = F.sum(e).over(whole)
        usable = (total > 0) & ~F.isnan(total) & (total != float("inf"))
        return F.when(usable, e / total).otherwise(1.0 / F.count(F.lit(1)).over(whole)) * 100.0

    rows = joined.select("*", percent("raw_t0").alias("pct_t0"), percent("raw_t1").alias("pct_t1"))
    return rows.withColumn("delta_pct", F.col("pct_t1") - F.col("pct_t0"))


def movers(deltas, keys=("pair",), k=None):
    """Deltas by absolute size, ties by label (L1); the first ``k`` if given."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("delta_pct"), SCORE_DIGITS)), "label")
    ranked = deltas.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def mover_text(deltas, keys=("pair",), k=TOP_MOVERS):
    """'label +0.0pp' of the biggest movers, comma separated."""
    top = movers(deltas, keys, k)
    sign = F.when(F.round("delta_pct", 1) < 0, "").otherwise("+")
    part = F.concat("label", F.lit(" "), sign, fixed("delta_pct", "0.0"), F.lit("pp"))
    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("a"))
    return rows.select(*keys, F.array_join(F.transform("a", lambda p: p["t"]), ", ").alias("movers"))


def agreement(optical, radar, key="vec_id"):
    """Shared and one-sided labels of two label sets per scene.

    Inputs are (key, label) rows of at most a vocabulary per scene.
    """
    side = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias(name))
    none = F.array().cast("array<string>")
    both = side(optical, "o").join(side(radar, "r"), key, "full_outer").select(
        key, F.coalesce("o", none).alias("o"), F.coalesce("r", none).alias("r")
    )
    shared = F.array_intersect("o", "r")
    union = F.size(F.array_union("o", "r"))
    percent = F.size(shared) / F.greatest(union, F.lit(1)) * 100
    return both.select(
        key,
        F.array_sort(shared).alias("agreement"),
        F.array_sort(F.array_except("o", "r")).alias("optical_only"),
        F.array_sort(F.array_except("r", "o")).alias("sar_only"),
        F.bround(percent, 1).alias("agreement_pct"),
        F.bround(100.0 - percent, 1).alias("disagreement_pct"),
    )


def before_after(metrics):
    """Difference of each metric between the encoders (A24): rows (encoder, metric, value)."""
    pick = lambda e: F.max(F.when(F.col("encoder") == e, F.col("value")))
    return metrics.groupBy("metric").agg(pick("before").alias("before"), pick("after").alias("after")).withColumn(
        "delta", F.col("after") - F.col("before")
    )


def encode(rows, encoder, value, out="e", batch=32):
    """Run a user's encoder over arrays or texts in batches.

    ``encoder`` is called once per task and returns a function from a list of
    values to a list of vectors.
    """
    names = [f.name for f in rows.schema if f.name != value]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != value)

    def run(batches):
        model = encoder()
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                result = part[names].copy()
                result[out] = [list(map(float, v)) for v in model(part[value].tolist())]
                yield result

    return rows.mapInPandas(run, f"{fields}, {out} array<double>")
