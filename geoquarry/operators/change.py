"""Two-date change: radiometric match, threshold, mask, accuracy, registration
(W3, W4, A4, A5, A7, A26, J14, L6, P30, P31)."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.functions.text import fixed
from geoquarry.operators.grid import morph
from geoquarry.operators.scale import join_facts
from geoquarry.session import reliable_checkpoint
from geoquarry.sources.blocks import to_pixels

# Fixed values of matching and confidence.
GOOD_DISTANCE, MIN_GOOD, SATURATION = 50, 3, 25.0
DETECTION_THRESHOLD = 0.2
FEW_CONFIDENCE, NO_FEATURE_CONFIDENCE = 0.15, 0.05
WITH_DELTA, WITHOUT_DELTA = 0.8, 0.2
FUSION_CONFIDENCE = {3: 0.7, 2: 0.5, 1: 0.3, 0: 0.1}
#: Keypoints per tile; an image of the reference's detector fits one tile.
KEYPOINT_TILE = 2500
#: Share of a pair's matches in a trimmed fit, and how often it is fitted again.
KEEP, REFITS = 0.625, 4
#: Pieces of a descriptor in multi-index hashing: fewer than GOOD_DISTANCE bits leave one piece with one bit at most.
PIECES = 25


def histogram(blocks, values, keys=("scene",)):
    """Pixels per level: at most 256 rows per scene."""
    return blocks.select(*keys, F.explode(values).alias("level")).groupBy(*keys, "level").count()


def _cdf(hist):
    run = Window.partitionBy("scene").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(
        "scene", "level", (F.sum("count").over(run) / F.sum("count").over(Window.partitionBy("scene"))).alias("q")
    )


def joint_histogram(pairs):
    """Pixels per pair of levels of the two dates: at most 65,536 rows per scene."""
    return (
        pairs.select("scene", F.explode(F.arrays_zip("g0", "g1")).alias("g"))
        .groupBy("scene", F.col("g.g0").alias("g0"), F.col("g.g1").alias("g1")).count()
    )


def match_table(pairs):
    """Level of date 1 -> matched level of date 0 (W3): (scene, level, matched).

    The quantile of each source level is placed between the two nearest
    quantiles of date 0 and interpolated, clamped at both ends, truncated.
    """
    return _match(joint_histogram(pairs))


def _match(joint):
    side = lambda name: joint.groupBy("scene", F.col(name).alias("level")).agg(F.sum("count").alias("count"))
    target = _cdf(side("g0")).select("scene", "q", F.col("level").alias("known"), F.lit(None).cast("int").alias("level"))
    source = _cdf(side("g1")).select("scene", "q", F.lit(None).cast("int").alias("known"), "level")
    both = target.unionByName(source)
    scene, late = Window.partitionBy("scene"), F.col("known").isNull().cast("int")
    up = scene.orderBy("q", late).rowsBetween(Window.unboundedPreceding, 0)
    # rows after this one, from the far end: a frame that only grows is passed once
    down = scene.orderBy(F.desc("q"), late.desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("known").isNotNull(), F.struct("q", "known"))
    placed = both.select(
        "scene", "q", "level",
        F.last(here, ignorenulls=True).over(up).alias("a"),
        F.last(here, ignorenulls=True).over(down).alias("b"),
    ).where(F.col("level").isNotNull())
    a, b = F.col("a"), F.col("b")
    slope = (b["known"] - a["known"]) / (b["q"] - a["q"])
    value = (
        F.when(a.isNull(), b["known"].cast("double"))
        .when(b.isNull(), a["known"].cast("double"))
        .otherwise(slope * (F.col("q") - a["q"]) + a["known"])
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))
    return placed.select("scene", "level", clipped.cast("int").alias("matched"))


def _lookup(matches):
    """Per scene, the matched level of each of the 256 levels."""
    known = F.map_from_entries(F.collect_list(F.struct("level", "matched")))
    # as a variable the map is made once; as a column it would be made again for each level
    table = F.transform(F.array("_map"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: m[i]))
    return matches.groupBy("scene").agg(known.alias("_map")).select("scene", F.get(table, F.lit(0)).alias("_lut"))


def _distance(p, q):
    return F.abs(p - F.get(F.col("_lut"), q))


def difference(pairs):
    """Blocks of |date 0 - matched date 1|."""
    rows = pairs.join(_lookup(match_table(pairs)), "scene")
    return rows.withColumn("data", F.zip_with("g0", "g1", _distance)).drop("_lut")


def difference_levels(pairs):
    """Matched levels and the histogram of the difference, per scene, from one pass over the pixels.

    Both follow from the joint histogram of the two dates: no difference block is built.
    """
    joint = joint_histogram(pairs)
    lookup = _lookup(_match(joint))
    levels = joint.join(lookup, "scene").groupBy("scene", _distance(F.col("g0"), F.col("g1")).alias("level")).agg(F.sum("count").alias("count"))
    return lookup, levels


def class_variance(diff):
    """Between-class variance of a split after each level (W4); null after the last."""
    return _variance(histogram(diff, "data"))


def _variance(hist):
    run = Window.partitionBy("scene").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("scene")
    moment = F.col("count") * F.col("level")
    sums = hist.select(
        "scene", "level",
        F.sum("count").over(run).alias("n0"), F.sum(moment).over(run).alias("s0"),
        F.sum("count").over(whole).alias("n"), F.sum(moment).over(whole).alias("s"),
    )
    share = F.col("n0") / F.col("n")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.nullif(F.col("n") - F.col("n0"), F.lit(0))
    return sums.withColumn("variance", F.when(F.col("n0") < F.col("n"), share * (1 - share) * gap * gap))


def otsu(diff):
    """Histogram threshold with the largest between-class variance (A4).

    The first level wins a tie; a scene with one level gets 0.
    """
    return _threshold(histogram(diff, "data"))


def _threshold(hist):
    best = F.max(F.struct(F.coalesce("variance", F.lit(-1.0)).alias("v"), (-F.col("level")).alias("l")))
    return _variance(hist).groupBy("scene").agg(best.alias("b")).select(
        "scene", F.when(F.col("b.v") > 0, -F.col("b.l")).otherwise(0).alias("threshold"),
        F.greatest(F.col("b.v"), F.lit(0.0)).alias("variance"),
    )


def change_mask(pairs, size=512, levels=None):
    """Difference, threshold and cleaned mask: blocks with ``data`` (0 or 255).

    ``levels`` is the result of :func:`difference_levels` where it is at hand.
    """
    lookup, hist = levels or difference_levels(pairs)
    limits = lookup.join(_threshold(hist).select("scene", "threshold"), "scene")
    over = lambda p, q: F.when(_distance(p, q) > F.col("threshold"), 255).otherwise(0)
    marks = pairs.join(limits, "scene").select("scene", "by", "bx", "h", "w", F.zip_with("g0", "g1", over).alias("data"))
    return morph(marks, size=size)


def diff_stats(pairs, size=512):
    """Difference and mask statistics per scene (A5): one pass for the levels, one for the mask."""
    lookup, hist = difference_levels(pairs)
    n = F.sum("count")
    facts = hist.groupBy("scene").agg(
        (F.sum(F.col("level") * F.col("count")) / n).alias("diff_mean"),
        F.max("level").alias("diff_max"),
        n.alias("total_pixels"),
    )
    changed = change_mask(pairs, size, (lookup, hist)).groupBy("scene").agg(
        F.sum(F.size(F.filter("data", lambda v: v > 0))).alias("changed_pixels")
    )
    return facts.join(_threshold(hist).select("scene", "threshold"), "scene").join(changed, "scene").withColumn(
        "changed_fraction", F.col("changed_pixels") / F.col("total_pixels")
    )


def truth_mask(pairs):
    """Pixels whose class differs between the dates."""
    return pairs.select(
        "scene", "by", "bx", "h", "w", F.zip_with("l0", "l1", lambda a, b: F.when(a != b, 255).otherwise(0)).alias("data")
    )


def mask_scores(predicted, truth):
    """Hits and errors per scene with precision, recall and IoU."""
    a = predicted.select("scene", "by", "bx", "h", "w", F.col("data").alias("p"))
    b = truth.select("scene", "by", "bx", F.col("data").alias("t"))
    both = a.join(b, ["scene", "by", "bx"], "full_outer")
    bad = F.col("p").isNull() | F.col("t").isNull() | (F.size("p") != F.size("t"))
    both = both.withColumn("bad", bad)
    # 0 to 3: neither, missed, said wrongly, hit; counted inside the block
    kind = F.zip_with(F.col("p").cast("array<int>"), F.col("t").cast("array<int>"), lambda p, t: F.when(p > 0, 2).otherwise(0) + F.when(t > 0, 1).otherwise(0))
    blocks = both.select("scene", "bad", F.when(~F.col("bad"), kind).alias("kind"))
    count = lambda k: F.coalesce(F.sum(F.size(F.filter("kind", lambda v: v == k))), F.lit(0)).cast("long")
    sums = blocks.groupBy("scene").agg(
        F.max("bad").alias("bad"), F.coalesce(F.sum(F.size("kind")), F.lit(0)).alias("n"), count(3).alias("tp"), count(2).alias("fp"), count(1).alias("fn"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "scene", "bad", "n", "tp", "fp", "fn",
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tp, tp + fp + fn).alias("iou"),
        rate(tp + fn, F.col("n")).alias("gt_rate"), rate(tp + fp, F.col("n")).alias("pred_rate"),
    )


def mask_metrics(predicted, truth):
    """Means over scenes, deviation, trivial floor and error count."""
    rows = mask_scores(predicted, truth)
    ok = ~F.col("bad")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return rows.agg(
        F.count(F.when(ok, 1)).alias("n"), F.count(F.when(~ok, 1)).alias("errors"),
        mean("precision").alias("precision"), F.stddev_pop(F.when(ok, F.col("precision"))).alias("precision_sd"),
        mean("recall").alias("recall"), mean("iou").alias("iou"), mean("gt_rate").alias("gt_change_rate"),
        mean("pred_rate").alias("pred_change_rate"), mean("gt_rate").alias("baseline_precision"),
    )


def match_descriptors(first, second, keys=("pair",), tile=KEYPOINT_TILE):
    """Mutual nearest matches by differing bits.

    Keypoint rows: keys, ``kp, x, y, d0..d3``.  Keypoints are dealt to as many tiles as
    their image fills; tiles meet pairwise, many small ones in one task, and each
    tile pair reports only the nearest partner of each keypoint, both
    ways; ties go to the smaller keypoint number.
    """
    keys = list(keys)
    words = ["d0", "d1", "d2", "d3"]
    place = [*keys, "_l", "_r"]

    first, second = (d.where(F.col("kp").isNotNull()) for d in (first, second))
    counted = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    # an image is cut by its own number of keypoints, whatever their numbers are
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    sizes = counted(first, "_ln").join(counted(second, "_rn"), keys).withColumns({"_ls": tiles("_ln"), "_rs": tiles("_rn")})
    # tile pairs go by groups, about as large as a pair of full tiles
    load = F.sum(F.col("_ln") * F.col("_rs") + F.col("_rn") * F.col("_ls")) / (2 * tile)
    groups = sizes.agg(F.greatest(F.lit(1), F.ceil(load)).cast("int").alias("_n"))
    sizes = sizes.drop("_ln", "_rn")

    def dealt(df, own, other, at, to):
        held = join_facts(df.select(*keys, "kp", *words), sizes, keys)
        met = held.withColumn(at, F.pmod(F.xxhash64("kp"), F.col(own)).cast("int")).withColumn(to, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        met = met.crossJoin(F.broadcast(groups)).withColumn("_g", F.pmod(F.xxhash64(*place), F.col("_n")).cast("int")).select("_g", *place, "kp", *words)
        # fresh column identities, as both sides may come from one table
        return met.toDF(*met.columns).groupBy("_g")

    def cut(frame):
        """The frame sorted by tile pair and keypoint, its descriptors, and the rows of each tile pair."""
        frame = frame.sort_values([*place, "kp"])
        bits = np.stack([frame[w].to_numpy() for w in words], axis=1)
        tiles = frame.groupby(place, sort=False)
        first_rows = np.r_[np.flatnonzero(np.diff(tiles.ngroup().to_numpy(), prepend=-1)), len(frame)]
        names = frame[place].iloc[first_rows[:-1]].itertuples(index=False, name=None)
        return frame, bits, dict(zip(names, zip(first_rows[:-1], first_rows[1:])))

    def nearest(x, y):
        names = [*keys, "side", "kp", "other", "distance"]
        if x.empty or y.empty:
            return pd.DataFrame(columns=names)
        (x, x_bits, x_tiles), (y, y_bits, y_tiles) = cut(x), cut(y)
        x_kp, y_kp = x["kp"].to_numpy(), y["kp"].to_numpy()
        found = []
        for name, (a, b) in x_tiles.items():
            c, d = y_tiles.get(name, (0, 0))
            if c == d:
                continue
            distance = np.zeros((b - a, d - c), dtype=np.int64)
            for w in range(len(words)):
                # counted as unsigned words: a signed count is that of the absolute value
                distance += np.bitwise_count((x_bits[a:b, w, None] ^ y_bits[None, c:d, w]).view(np.uint64))
            ahead, back = distance.argmin(axis=1), distance.argmin(axis=0)
            found.append((np.arange(a, b), c + ahead, distance[np.arange(b - a), ahead], a + back, np.arange(c, d), distance[back, np.arange(d - c)]))
        if not found:
            return pd.DataFrame(columns=names)
        x_at, y_near, x_far, x_near, y_at, y_far = (np.concatenate(part) for part in zip(*found))
        whose = x[keys].iloc[np.r_[x_at, x_near]].reset_index(drop=True)
        return whose.assign(
            side=np.repeat([0, 1], [len(x_at), len(y_at)]), kp=np.r_[x_kp[x_at], y_kp[y_at]],
            other=np.r_[y_kp[y_near], x_kp[x_near]], distance=np.r_[x_far, y_far])[names]

    types = dict(first.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "side int, kp long, other long, distance long"])
    near = dealt(first, "_ls", "_rs", "_l", "_r").cogroup(dealt(second, "_rs", "_ls", "_r", "_l")).applyInPandas(nearest, schema)
    best = near.groupBy(*keys, "side", "kp").agg(F.min(F.struct("distance", "other")).alias("b"))
    ahead = best.where("side = 0").select(*keys, F.col("kp").alias("kp0"), F.col("b.other").alias("kp1"), F.col("b.distance").alias("distance"))
    back = best.where("side = 1").select(*keys, F.col("kp").alias("kp1"), F.col("b.other").alias("kp0"))
    return ahead.join(back, [*keys, "kp0", "kp1"])


def _pieces(words):
    """The bits of descriptors (rows of four 64-bit words) dealt to PIECES numbers: bit i goes to piece i modulo PIECES.

    Neighbouring bits go to different pieces, so bits that hardly vary spread over all of them.
    """
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return np.stack([bits[:, j::PIECES] @ (1 << np.arange(len(range(j, bits.shape[1], PIECES)))) for j in range(PIECES)], axis=1)


def _piece_keys(df, keys, probe):
    """Keypoint rows with one ``key`` for each piece; a ``probe`` has those of all pieces one bit away as well."""
    names = [*keys, "kp", "d0", "d1", "d2", "d3"]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "kp long, d0 long, d1 long, d2 long, d3 long, key array<int>"])

    def run(batches):
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy() for c in names[-4:]], axis=1)
            values = _pieces(words)
            width = -(-64 * words.shape[1] // PIECES)
            own = np.arange(PIECES)[None, :] << width | values
            if probe:
                # a piece one bit shorter has no neighbour at its last place
                flips = np.concatenate([[0], 1 << np.arange(width)])
                own = (own[:, :, None] ^ flips).reshape(len(words), -1)
            ends = pa.array(np.arange(len(words) + 1) * own.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(own.ravel().astype(np.int32)))], names=[*names, "key"])

    rows = df.select(*keys, F.col("kp").cast("long").alias("kp"), *[F.col(c).cast("long").alias(c) for c in names[-4:]])
    return rows.mapInArrow(run, schema).withColumn("key", F.explode("key"))


def near_candidates(first, second, keys=("pair",)):
    """Keypoint pairs that agree in some piece of their descriptors up to one bit, with their ``distance``.

    The 256 bits are dealt to 25 pieces: of 49 differing bits at most, some piece
    holds one or none, so pairs nearer than ``GOOD_DISTANCE`` meet in an equi join
    on piece values, the first side probing each value and its neighbours.  A
    pair comes once for each value that it shares.
    """
    keys = list(keys)
    a, b = _piece_keys(first, keys, True), _piece_keys(second, keys, False)
    a = a.select(*keys, "key", F.col("kp").alias("kp0"), *[F.col(f"d{i}").alias(f"a{i}") for i in range(4)])
    b = b.select(*keys, "key", F.col("kp").alias("kp1"), *[F.col(f"d{i}").alias(f"b{i}") for i in range(4)])
    distance = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return a.join(b, [*keys, "key"]).select(*keys, "kp0", "kp1", distance.cast("long").alias("distance"))


def match_near(first, second, keys=("pair",), limit=GOOD_DISTANCE):
    """The mutual nearest matches below ``limit`` bits by multi-index hashing.

    The same rows as :func:`match_descriptors` followed by :func:`good_matches`:
    a nearest partner below the limit is nearest among all.  For images of very many
    keypoints, where tiles would meet all pairs; with a few thousand each,
    tiles are cheaper.  Nearest partners are found by partial minima, so a
    pair that shares several values does no harm.
    """
    if limit > GOOD_DISTANCE:
        raise ValueError(f"pieces reach distances below {GOOD_DISTANCE} only")
    keys = list(keys)
    near = near_candidates(first, second, keys).where(F.col("distance") < limit)
    side = lambda one, other: near.groupBy(*keys, one).agg(F.min(F.struct("distance", other)).alias("b"))
    ahead = side("kp0", "kp1").select(*keys, "kp0", F.col("b.kp1").alias("kp1"), F.col("b.distance").alias("distance"))
    return ahead.join(side("kp1", "kp0").select(*keys, "kp1", F.col("b.kp0").alias("kp0")), [*keys, "kp0", "kp1"])


def good_matches(matches, limit=GOOD_DISTANCE):
    return matches.where(F.col("distance") < limit)


def ordered_matches(matches):
    """Matches numbered by distance, then keypoint.

    Distances are small integers: counts per distance give each one its offset
    and the numbering inside one distance runs per pair and distance.
    """
    per = matches.groupBy("pair", "distance").count()
    before = Window.partitionBy("pair").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("pair", "distance", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("pair", "distance").orderBy("kp0")
    return matches.join(offsets, ["pair", "distance"]).select(
        "kp0", "distance", (F.row_number().over(inside) - 1 + F.col("_o")).alias("position")
    )


def registration(matches, first, second, keys=("pair",)):
    """Mechanism and confidence of each pair from its matches."""
    keys = list(keys)
    counts = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    rows = (
        counts(first, "keypoints_t0")
        .join(counts(second, "keypoints_t1"), keys, "full_outer")
        .join(counts(good_matches(matches), "good"), keys, "left")
        .na.fill(0)
    )
    good = F.col("good")
    confidence = F.least(good / SATURATION, F.lit(1.0))
    blank = (F.col("keypoints_t0") == 0) | (F.col("keypoints_t1") == 0)
    return rows.select(
        "*",
        F.when(blank, NO_FEATURE_CONFIDENCE).when(good < MIN_GOOD, F.least(confidence, F.lit(FEW_CONFIDENCE)))
        .otherwise(confidence).alias("confidence"),
        F.when(blank | (good < MIN_GOOD), "no_warp_fallback").otherwise("orb_affine").alias("mechanism"),
    )


def fit_similarity(points, keys=("pair",)):
    """Rotation, scale and shift taking (x, y) to (u, v) by least squares.

    Sums are moments about zero in one pass; a single position gives nulls.
    """
    x, y, u, v = (F.col(c) for c in "xyuv")
    s = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(u).alias("su"), F.sum(v).alias("sv"),
        F.sum(x * x + y * y).alias("sq"), F.sum(x * u + y * v).alias("along"), F.sum(x * v - y * u).alias("across"),
    )
    n = F.col("n")
    spread = F.col("sq") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / n
    usable = (n >= 2) & (F.abs(spread) > 1e-9)
    a = F.when(usable, (F.col("along") - (F.col("sx") * F.col("su") + F.col("sy") * F.col("sv")) / n) / spread)
    b = F.when(usable, (F.col("across") - (F.col("sx") * F.col("sv") - F.col("sy") * F.col("su")) / n) / spread)
    fit = s.select(*keys, "n", "sx", "sy", "su", "sv", a.alias("a"), b.alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    return fit.select(
        *keys, "n", "a", "b",
        ((F.col("su") - a * F.col("sx") + b * F.col("sy")) / n).alias("tx"),
        ((F.col("sv") - b * F.col("sx") - a * F.col("sy")) / n).alias("ty"),
        F.sqrt(a * a + b * b).alias("scale"),
        F.degrees(F.atan2(b, a)).alias("rotation"),
    )


def fit_trimmed(points, keys=("pair",), keep=KEEP, rounds=REFITS):
    """:func:`fit_similarity` that leaves the worst matches out.

    After each fit the squared residual of every match is taken, and the next fit
    uses the matches up to the ``keep`` quantile of their pair.  Wrong matches up to
    about 1 - ``keep`` of a pair lose their pull within a few rounds.
    ``n`` counts the matches of the last fit.  Quantiles come from mergeable
    sketches, so a pair of any size stays spread; the points are kept once
    and each round's fits, a row per pair, are cut from their lineage.
    """
    keys = list(keys)
    points = reliable_checkpoint(points.select(*keys, "x", "y", "u", "v"))
    fit = reliable_checkpoint(fit_similarity(points, keys))
    for _ in range(rounds):
        held = points.join(fit.select(*keys, "a", "b", "tx", "ty"), keys)
        du = F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx") - F.col("u")
        dv = F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty") - F.col("v")
        off = held.withColumn("off", du * du + dv * dv)
        limits = off.groupBy(*keys).agg(F.percentile_approx("off", keep, 10000).alias("limit"))
        fit = reliable_checkpoint(fit_similarity(off.join(limits, keys).where(F.col("limit").isNull() | (F.col("off") <= F.col("limit"))), keys))
    return fit


def change_confidence(registration_confidence, mask_written, has_delta):
    """Mean of registration, delta and mask evidence, within [0, 1]."""
    parts = (
        registration_confidence
        + F.when(has_delta, WITH_DELTA).otherwise(WITHOUT_DELTA)
        + F.when(mask_written, 1.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts / 3))


def fusion_confidence(sources):
    """Confidence from the number of evidence sources."""
    chain = F.lit(FUSION_CONFIDENCE[0])
    for n in (1, 2, 3):
        chain = F.when(sources >= n, FUSION_CONFIDENCE[n]).otherwise(chain)
    return chain


def change_text(mechanism, good, confidence, reason, changed_fraction, movers, side0, side1):
    """Summary sentence of a change run (P30); null movers drop their sentence."""
    shown = fixed(confidence, "0.00")
    registered = (
        F.when(mechanism == "skip_already_coregistered", "registration skipped (t0/t1 already share CRS and transform)")
        .when(mechanism == "orb_affine", F.concat(
            F.lit("ORB feature-based affine registration ("), good.cast("string"),
            F.lit(" good matches, registration confidence "), shown, F.lit(")")))
        .otherwise(F.concat(
            F.lit("registration fallback, no warp applied ("), reason, F.lit("; registration confidence "), shown, F.lit(")")))
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("Bi-temporal change analysis, t0 "), side0, F.lit(" vs t1 "), side1, F.lit(". "), registered, F.lit(".")),
        F.concat(F.lit("Differencing + morphological cleanup flags "),
                 fixed(changed_fraction * 100, "0.0"), F.lit("% of pixels as changed.")),
        F.concat(F.lit("Largest encoder class-confidence shifts between the two dates: "), movers, F.lit(".")),
    )


def grounding_text(n, target, best):
    """Summary sentence of a detection run."""
    return F.when(
        n > 0,
        F.concat(F.lit("Detected "), n.cast("string"), F.lit(" instance(s) of '"), target,
                 F.lit("'. Highest-confidence detection scores "), fixed(best, "0.00"), F.lit(".")),
    ).otherwise(F.concat(F.lit("No '"), target, F.lit(f"' detected above the confidence threshold ({DETECTION_THRESHOLD}).")))


def fusion_text(side0, side1, agree_n, agree_pct, optical_only, sar_only, water, built):
    """Summary sentence of a fusion run."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Cross-modal fusion of optical ("), side0, F.lit(") and SAR ("), side1, F.lit(") data.")),
        F.concat(F.lit("BEN predictions: "), agree_n.cast("string"), F.lit(" classes agree ("),
                 fixed(agree_pct, "0"), F.lit("%), "), optical_only.cast("string"), F.lit(" optical-only, "),
                 sar_only.cast("string"), F.lit(" SAR-only.")),
        F.when(water, "SAR physics: potential water body detected (low VV backscatter)."),
        F.when(built, "SAR physics: possible built-up area (high backscatter + double-bounce)."),
    )
