"""Overlap joins without given pairs: plane sweep inside groups, and a grid in front of it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.operators.scale import finite, numbered
from geoquarry.session import reliable_checkpoint

#: Rows of a group that meet in one task; a larger group is cut into strips of as many.
BOUND = 100_000
#: Candidate pairs tested at once.
_TESTED = 1 << 18
CORNERS = ["xmin", "ymin", "xmax", "ymax"]
#: Which classes of rows meet: (home or visitor, wide role) pairs; see :func:`sweep_pairs`.
_MEET = [((1, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 0), (0, 0)), ((1, 0), (0, 1)), ((1, 1), (0, 0))]


def usable(df):
    """Rows whose box has four finite corners and a positive extent both ways.

    The corners are worked out once a row, in front of the filter: a filter that
    Spark moves to the scan repeats their expressions wherever it names a corner.
    """
    df = df.select(*[c for c in df.columns if c not in CORNERS], F.inline(F.array(F.struct(*CORNERS))))
    ok = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    for c in CORNERS:
        ok = ok & finite(F.col(c))
    return df.where(ok)


def sweep_pairs(boxes, keys, bound=BOUND):
    """All pairs of boxes of one key that share a positive area.

    ``boxes``: keys, ``id``, the corners, and ``role``: 0 meets every row of the
    key, 1 only those of role 0.  Output: keys, ``a`` < ``b`` (ids), the shared
    rectangle (``left, bottom, right, top``) and both areas ``area_a, area_b``.
    Rows of one id are no pair.

    Within a key boxes are swept by their left edges: a box is compared with
    those whose left edge lies within its own width.  A key of more than ``bound``
    rows is cut into strips of ``bound`` left edges each (by rank, so equal edges
    are cut as well); a box visits the later strips it reaches, a pair is found
    where the later of its left edges is at home, and the visitors of a strip are dealt
    out by rank so that a task holds at most about twice ``bound`` rows.
    """
    keys = list(keys)
    rows = usable(boxes).select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in CORNERS], F.col("role").cast("int").alias("role"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # counted once; most tables have no such key
    large = reliable_checkpoint(sizes.where(F.col("_n") > bound).select(*keys))
    crowded = not large.isEmpty()
    plain = rows.join(large, keys, "left_anti") if crowded else rows
    dealt = plain.select(*rows.columns, F.lit(0).alias("strip"), F.lit(0).alias("block"), F.lit(1).alias("home"))
    if crowded:
        dealt = dealt.unionByName(_strips(rows.join(large, keys, "left_semi").select(*rows.columns), keys, bound))
    names = [*keys, "strip", "block"]
    order = [*names, "xmin"]
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} {kinds['id']}" for c in "ij"]
                       + [f"{c} double" for c in ("left", "bottom", "right", "top", "area_i", "area_j")])
    found = dealt.repartition(*names).sortWithinPartitions(*order).mapInArrow(_sweeper(keys), schema)
    swap = F.col("i") > F.col("j")
    return found.where("i <> j").select(
        *keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "left", "bottom", "right", "top",
        F.when(swap, F.col("area_j")).otherwise(F.col("area_i")).alias("area_a"),
        F.when(swap, F.col("area_i")).otherwise(F.col("area_j")).alias("area_b"),
    )


def _strips(rows, keys, bound):
    """Rows of large keys with the strips they reach and the block of each, see :func:`sweep_pairs`."""
    ranked = numbered(rows, keys, ["xmin", "id"], "_at").withColumn("own", F.floor(F.col("_at") / bound).cast("int"))
    # one left edge for each strip of a key
    edges = ranked.groupBy(*keys, "own").agg(F.min("xmin").alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    reach = ranked.join(edges, keys).withColumn("last", F.size(F.filter("edges", lambda e: e < F.col("xmax"))) - 1)
    sent = reach.select(*rows.columns, "_at", "own", F.explode(F.sequence("own", F.greatest("own", "last"))).alias("strip")).withColumn(
        "home", (F.col("own") == F.col("strip")).cast("int")
    )
    guests = sent.where("home = 0").groupBy(*keys, "strip").agg(F.ceil(F.count(F.lit(1)) / bound).cast("int").alias("parts"))
    dealt = sent.join(guests, [*keys, "strip"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = F.when(F.col("home") == 0, F.array((F.col("_at") % F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.select(*rows.columns, "strip", F.explode(block).alias("block"), "home")


def _sweeper(keys):
    """Arrow function over rows sorted by group and left edge; the last group of a batch waits for the next one."""

    def group_starts(batch):
        new = np.zeros(batch.num_rows, bool)
        if batch.num_rows:
            new[0] = True
        for name in [*keys, "strip", "block"]:
            column = batch.column(name)
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            if not batch.num_rows:
                continue
            new = group_starts(batch)
            last = int(np.flatnonzero(new)[-1])
            yield from pairs(batch.slice(0, last), new[:last])
            rest = batch.slice(last)
        if rest is not None:
            yield from pairs(rest, group_starts(rest))

    def pairs(batch, new):
        if batch.num_rows < 2:
            return
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        xmin, ymin, xmax, ymax = (column(c) for c in CORNERS)
        area = (xmax - xmin) * (ymax - ymin)
        home, role, first = column("home"), column("role"), column("block") == 0
        for i, j in candidates(np.cumsum(new), xmin, xmax, home, role):
            on = (ymin[i] < ymax[j]) & (ymin[j] < ymax[i]) & (first[i] | (home[i] != home[j]))
            i, j = i[on], j[on]
            # the keys of both rows are the same
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(i)) for k in keys] + [batch.column("id").take(pa.array(x)) for x in (i, j)]
                + [pa.array(x) for x in (np.maximum(xmin[i], xmin[j]), np.maximum(ymin[i], ymin[j]), np.minimum(xmax[i], xmax[j]),
                                         np.minimum(ymax[i], ymax[j]), area[i], area[j])],
                names=[*keys, "i", "j", "left", "bottom", "right", "top", "area_i", "area_j"],
            )

    return run


def candidates(group, xmin, xmax, home, role):
    """Index pairs of one group whose extents meet along x, each once; rows come sorted by group and ``xmin``."""
    edges = np.unique(np.concatenate([xmin, xmax]))
    low, high = (group * (len(edges) + 1) + np.searchsorted(edges, x) for x in (xmin, xmax))
    members = {c: np.flatnonzero((home == c[0]) & (role == c[1])) for c in {c for pair in _MEET for c in pair}}
    for p, q in _MEET:
        i, j = members[p], members[q]
        if not len(i) or not len(j):
            continue
        if p == q:
            yield from _expanded(i, j, np.arange(1, len(i) + 1), np.searchsorted(low[j], high[i]))
        else:
            yield from _expanded(i, j, np.searchsorted(low[j], low[i]), np.searchsorted(low[j], high[i]))
            yield from _expanded(j, i, np.searchsorted(low[i], low[j], side="right"), np.searchsorted(low[i], high[j]))


def _expanded(i, j, start, end):
    """Pairs of each of ``i`` with the rows ``j[start:end]``, in pieces."""
    size = np.maximum(end - start, 0)
    upto = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _TESTED, side="right")) - 1)
        if upto[to] > upto[at]:
            n = size[at:to]
            offset = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], n)
            yield np.repeat(i[at:to], n), j[np.repeat(start[at:to], n) + offset]
        at = to


def overlapping(boxes, bound=BOUND):
    """All pairs of boxes (``id`` and corners) that share a positive area, by a grid join.

    A box lies in cells of its own size (the next power of two above its longer
    side), four at most, and is shown to larger boxes in the cells of their
    sizes.  The number of sizes that occur is bounded by the exponents of a double, and only
    cells that hold a box of their own size are filled.  Boxes of a cell meet in
    :func:`sweep_pairs`, which cuts crowded cells again; a pair is kept in the
    cell that holds the lower left corner of its shared rectangle.
    """
    rows = usable(boxes).select("id", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    longest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    farthest = F.greatest(*[F.abs(c) for c in CORNERS])
    # cells so small that their numbers would not fit a double are of no use
    level = F.greatest(F.ceil(F.log2(longest)), F.when(farthest > 0, F.ceil(F.log2(farthest)) - 50).otherwise(F.lit(-1000)))
    sized = rows.withColumn("level", level.cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")

    def celled(df, role):
        spread = df.withColumn("cx", F.explode(F.sequence(cell("xmin"), cell("xmax")))).withColumn("cy", F.explode(F.sequence(cell("ymin"), cell("ymax"))))
        return spread.select("level", "cx", "cy", "id", *CORNERS, F.lit(role).alias("role"))

    own = celled(sized, 0)
    # at most one row for each exponent of a double
    levels = F.broadcast(sized.select("level").distinct().withColumnRenamed("level", "larger"))
    smaller = sized.join(levels, F.col("larger") > F.col("level")).withColumn("level", F.col("larger")).drop("larger")
    keys = ["level", "cx", "cy"]
    shown = celled(smaller, 1).join(own.select(*keys).distinct(), keys, "left_semi")
    found = sweep_pairs(own.unionByName(shown), keys, bound)
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")
    return found.where((at("left") == F.col("cx")) & (at("bottom") == F.col("cy"))).drop(*keys)
