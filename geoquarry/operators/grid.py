"""Grid work: alignment, resampling, stencils, components.

Blocks meet the neighbours they need in one shuffle; a kernel then computes the
whole chain of steps for its block.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.operators import kernels
from geoquarry.operators.scale import join_facts
from geoquarry.session import reliable_checkpoint
from geoquarry.sources.blocks import to_pixels

# Fixed values of the legacy mask quality.
LEGACY_THRESHOLD, SIGNAL_AREA = 45, 100
SNR_NOISE, SNR_RATIO = 1e-6, 1e-7
#: Pixels of windows worked on at once.
_PIXELS = 1 << 22
TRUST_REGISTRATION, TRUST_COHERENCE, TRUST_LIMIT = 0.4, 0.6, 0.45


def align_px(first, second, keys=("scene",)):
    """Pixels of two rasters side by side, joined block to block.

    Returns the pixel rows (a, b) and the blocks whose sizes differ or that lack
    a partner.
    """
    keys = list(keys)
    a = first.select(*keys, "by", "bx", "h", "w", F.col("data").alias("a"))
    b = second.select(*keys, "by", "bx", F.col("data").alias("b"))
    both = a.join(b, [*keys, "by", "bx"], "full_outer")
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.size("a") != F.size("b"))
    errors = both.where(bad).select(*keys, "by", "bx", F.lit("shape mismatch").alias("error"))
    return to_pixels(both.where(~bad), ("a", "b"), ("a", "b"), keep=tuple(keys)), errors


def _piece(dy, dx, halo):
    """The part of a block a neighbour at (dy, dx) needs."""
    h, w = F.col("h"), F.col("w")
    r0 = F.when(dy > 0, F.greatest(h - halo, F.lit(0))).otherwise(0)
    r1 = F.when(dy < 0, F.least(h, F.lit(halo))).otherwise(h)
    c0 = F.when(dx > 0, F.greatest(w - halo, F.lit(0))).otherwise(0)
    c1 = F.when(dx < 0, F.least(w, F.lit(halo))).otherwise(w)
    lines = F.transform(F.sequence(r0, r1 - 1), lambda r: F.slice("data", r * w + c0 + 1, c1 - c0))
    return F.struct(
        (F.col("by") + r0).alias("by"), (F.col("bx") + c0).alias("bx"),
        (r1 - r0).alias("h"), (c1 - c0).alias("w"), F.flatten(lines).alias("data"),
    )


def in_step(blocks, size):
    """``blocks``, failing where they do not lie on a grid of ``size``: neighbours are addressed by it."""
    off = (F.col("by") % size != 0) | (F.col("bx") % size != 0) | (F.col("h") > size) | (F.col("w") > size)
    wrong = F.raise_error(F.concat(F.lit(f"blocks are not on a grid of {size}: "), F.to_json(F.struct("by", "bx", "h", "w"))))
    return blocks.withColumn("by", F.when(off, wrong.cast("int")).otherwise(F.col("by")))


def with_halo(blocks, keys, size, halo):
    """Each block with the edges of its eight neighbours: ``parts`` (at most nine)."""
    keys, blocks = list(keys), in_step(blocks, size)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    sent = blocks.select(*keys, "by", "bx", "h", "w", F.col("data").cast("array<double>").alias("data"), F.explode(steps).alias("_dy"))
    sent = sent.select("*", F.explode(steps).alias("_dx"))
    home = (F.col("_dy") == 0) & (F.col("_dx") == 0)
    sent = sent.select(
        *keys,
        (F.col("by") + F.col("_dy") * size).alias("ty"),
        (F.col("bx") + F.col("_dx") * size).alias("tx"),
        F.when(home, F.col("h")).alias("_h"),
        F.when(home, F.col("w")).alias("_w"),
        _piece(F.col("_dy"), F.col("_dx"), halo).alias("part"),
    )
    return (
        sent.groupBy(*keys, "ty", "tx")
        .agg(F.max("_h").alias("h"), F.max("_w").alias("w"), F.collect_list("part").alias("parts"))
        .where(F.col("h").isNotNull())
        .withColumnsRenamed({"ty": "by", "tx": "bx"})
    )


def morph(blocks, steps=("min", "max", "max", "min"), keys=("scene",), size=512, radius=1):
    """Neighbourhood minimum / maximum steps on ``data``.

    The default is opening then closing.  One shuffle brings a halo as wide as
    all steps together, so no step needs another exchange.
    """
    halo = radius * len(steps)
    if halo > size:
        raise ValueError("blocks are smaller than the halo the steps need")
    keys = list(keys)
    ready = with_halo(blocks, keys, size, halo)

    def run(batches):
        for batch in batches:
            by, bx, h, w = (batch.column(c).to_numpy() for c in ("by", "bx", "h", "w"))
            pieces = _Pieces(batch.column("parts"), by - halo, bx - halo)
            cuts = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)])
            out = np.empty(cuts[-1], np.int32)
            for height, width in {*zip(h.tolist(), w.tolist())}:
                alike = np.flatnonzero((h == height) & (w == width))
                most = max(1, _PIXELS // ((height + 2 * halo) * (width + 2 * halo)))
                for at in range(0, len(alike), most):
                    some = alike[at : at + most]
                    window, known = pieces.windows(some, height + 2 * halo, width + 2 * halo)
                    for step in steps:
                        window = kernels.neighbourhood(window, known, np.minimum if step == "min" else np.maximum, radius)
                    core = window[:, halo : halo + height, halo : halo + width].astype(np.int32)
                    out[cuts[some][:, None] + np.arange(height * width)] = core.reshape(len(some), -1)
            data = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 4], data], names=[*keys, "by", "bx", "h", "w", "data"])

    fields = ", ".join(f"{k} {dict(blocks.dtypes)[k]}" for k in keys)
    whole = [F.col(c).cast("int").alias(c) for c in ("by", "bx", "h", "w")]
    return ready.select(*keys, *whole, "parts").mapInArrow(run, f"{fields}, by int, bx int, h int, w int, data array<int>")


class _Pieces:
    """The pixels of the pieces of many blocks, with their places in windows that begin at given corners."""

    def __init__(self, parts, y0, x0):
        held = parts.values
        data = held.field("data")
        starts = data.offsets.to_numpy().astype(np.int64)
        size = np.diff(starts)
        numbers = lambda name: held.field(name).fill_null(0).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
        piece = np.repeat(np.arange(len(size)), size)
        line, column = np.divmod(np.arange(len(piece)) - np.repeat(starts[:-1] - starts[0], size), np.maximum(numbers("w"), 1)[piece])
        self.values = data.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
        self.owner = owner[piece]
        self.y = numbers("by")[piece] + line - y0[self.owner]
        self.x = numbers("bx")[piece] + column - x0[self.owner]

    def windows(self, owners, height, width):
        """Windows of one size, and which of their pixels are known."""
        place = np.full(int(self.owner.max(initial=0)) + 1, -1)
        place[owners[owners < len(place)]] = np.flatnonzero(owners < len(place))
        at = place[self.owner]
        on = (at >= 0) & (self.y >= 0) & (self.y < height) & (self.x >= 0) & (self.x < width)
        window, known = np.full((len(owners), height, width), np.nan), np.zeros((len(owners), height, width), bool)
        spot = at[on], self.y[on], self.x[on]
        window[spot], known[spot] = self.values[on], True
        return window, known


def _targets(geometry, keys, tile):
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1, F.lit(tile))
    rows = geometry.select("*", F.explode(span("out_h")).alias("ty")).select("*", F.explode(span("out_w")).alias("tx"))
    rows = rows.withColumns({
        "th": F.least(F.lit(tile), F.col("out_h") - F.col("ty")),
        "tw": F.least(F.lit(tile), F.col("out_w") - F.col("tx")),
    })

    def window(scale, shift, start, length, limit):
        first = F.floor(F.col(scale) * F.col(start) + F.col(shift))
        last = F.floor(F.col(scale) * (F.col(start) + F.col(length) - 1) + F.col(shift)) + 1
        inside = lambda v: F.greatest(F.lit(0), F.least(v, F.col(limit) - 1)).cast("int")
        return inside(F.least(first, last)), inside(F.greatest(first, last))

    y0, y1 = window("ay", "cy", "ty", "th", "src_h")
    x0, x1 = window("ax", "cx", "tx", "tw", "src_w")
    return rows.withColumns({"y0": y0, "y1": y1, "x0": x0, "x1": x1})


def resample(blocks, geometry, keys=("scene", "band"), mode="bilinear", size=512, tile=None, outside="edge"):
    """Read blocks on another grid.

    ``geometry`` has, per key, ``out_h, out_w, src_h, src_w`` and the linear map
    from output to source index: ``src = ay*out + cy`` (and ``ax, cx``).
    ``outside='edge'`` repeats the border, ``'missing'`` gives null.

    A source block is cut to the lines and columns that the output tile samples
    before it is sent, so what meets in a tile is bounded by the tile, however
    strong the reduction.
    """
    keys, tile = list(keys), tile or size
    targets = _targets(geometry, keys, tile)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    wanted = targets.select("*", cells("y0", "y1").alias("_i")).select("*", cells("x0", "x1").alias("_j"))
    wanted = wanted.withColumns({"by": (F.col("_i") * size).cast("int"), "bx": (F.col("_j") * size).cast("int")}).drop("_i", "_j")
    source = in_step(blocks, size).select(*keys, "by", "bx", "h", "w", F.col("data").cast("array<double>").alias("data"))
    spec = [*keys, "ty", "tx", "th", "tw", "src_h", "src_w", "ay", "cy", "ax", "cx"]
    types = dict(blocks.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    sent = wanted.join(source, [*keys, "by", "bx"], "left")
    # the lines and columns of a block that the tile samples, and the block cut to them
    sent = sent.withColumns({"ys": _needed("ay", "cy", "ty", "th", "src_h", mode, "by", "h"), "xs": _needed("ax", "cx", "tx", "tw", "src_w", mode, "bx", "w")})
    at = lambda y: F.transform("xs", lambda x: F.col("data")[((y - F.col("by")) * F.col("w") + x - F.col("bx")).cast("int")])
    parts = sent.select(*spec, F.struct("ys", "xs", F.flatten(F.transform("ys", at)).alias("data")).alias("part"))
    gathered = parts.groupBy(*spec).agg(F.collect_list("part").alias("parts"))

    def places(scale, shift, start, length, limit):
        """Source positions of a tile's lines, whether they lie in the image, and as they are read."""
        position = scale * np.arange(start, start + length) + shift
        return (position < -0.5) | (position > limit - 0.5), np.clip(np.floor(position) if mode == "nearest" else position, 0, limit - 1)

    def tile_values(r, pieces):
        """Pixels of a tile from its (lines, columns, values) pieces."""
        (off_y, iy), (off_x, ix) = places(r["ay"], r["cy"], r["ty"], r["th"], r["src_h"]), places(r["ax"], r["cx"], r["tx"], r["tw"], r["src_w"])
        if mode == "nearest":
            rows, cols = np.unique(iy.astype(int)), np.unique(ix.astype(int))
        else:
            low_y, low_x = np.floor(iy).astype(int), np.floor(ix).astype(int)
            rows = np.unique(np.concatenate([low_y, np.minimum(low_y + 1, r["src_h"] - 1)]))
            cols = np.unique(np.concatenate([low_x, np.minimum(low_x + 1, r["src_w"] - 1)]))
        window = np.full((len(rows), len(cols)), np.nan)
        for y, x, values in pieces:
            if len(y) and len(x):
                window[np.ix_(np.searchsorted(rows, y), np.searchsorted(cols, x))] = values.reshape(len(y), len(x))
        # positions among the lines that were sent
        py, px = (np.searchsorted(known, np.floor(i).astype(int)) + i - np.floor(i) for known, i in ((rows, iy), (cols, ix)))
        out = window[np.ix_(py.astype(int), px.astype(int))] if mode == "nearest" else kernels.sample(window, py, px)
        if outside == "missing":
            out[off_y, :] = np.nan
            out[:, off_x] = np.nan
        return out.ravel()

    def run(batches):
        for batch in batches:
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in spec[len(keys) :]}
            column = batch.column("parts")
            ends, held = column.offsets.to_numpy(), column.values
            lists = []
            for name in ("ys", "xs", "data"):
                inner = held.field(name)
                lists.append((inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)))
            tiles = []
            for i in range(batch.num_rows):
                pieces = ([values[cut[p] : cut[p + 1]] for cut, values in lists] for p in range(ends[i], ends[i + 1]))
                tiles.append(tile_values({c: v[i] for c, v in numbers.items()}, pieces))
            cuts = pa.array(np.cumsum([0, *map(len, tiles)]), pa.int32())
            data = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*tiles, np.empty(0)])))
            shape = [pa.array(numbers[c], pa.int32()) for c in ("ty", "tx", "th", "tw")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *shape, data], names=[*keys, "by", "bx", "h", "w", "data"])

    return gathered.mapInArrow(run, f"{fields}, by int, bx int, h int, w int, data array<double>")


def _needed(scale, shift, start, length, limit, mode, first, size):
    """Lines of a block (from ``first``, ``size`` of them) that a tile samples, ascending."""
    last = (F.col(limit) - 1).cast("double")
    inside = lambda v: F.greatest(F.lit(0.0), F.least(last, v))
    position = lambda k: F.col(scale) * (F.col(start) + k) + F.col(shift)
    if mode == "nearest":
        lines = F.transform(F.sequence(F.lit(0), F.col(length) - 1), lambda k: inside(F.floor(position(k)).cast("double")).cast("int"))
    else:
        low = F.transform(F.sequence(F.lit(0), F.col(length) - 1), lambda k: F.floor(inside(position(k))).cast("int"))
        lines = F.concat(low, F.transform(low, lambda v: F.least(v + 1, F.col(limit) - 1).cast("int")))
    here = F.filter(lines, lambda v: (v >= F.col(first)) & (v < F.col(first) + F.col(size)))
    return F.array_sort(F.array_distinct(here))


def raster_size(blocks, keys=("scene", "band")):
    return blocks.groupBy(*keys).agg(
        F.max(F.col("by") + F.col("h")).alias("src_h"), F.max(F.col("bx") + F.col("w")).alias("src_w")
    )


def resample_bilinear(blocks, height, width, keys=("scene", "band"), size=512):
    """Resize to height x width with half-pixel centres."""
    g = raster_size(blocks, keys)
    ay, ax = F.col("src_h") / float(height), F.col("src_w") / float(width)
    g = g.withColumns({"out_h": F.lit(height), "out_w": F.lit(width), "ay": ay, "ax": ax,
                       "cy": 0.5 * ay - 0.5, "cx": 0.5 * ax - 0.5})
    return resample(blocks, g, keys, "bilinear", size)


def resample_nearest(blocks, height, width, keys=("scene",), size=512):
    """Resize a mask by its nearest source pixel."""
    g = raster_size(blocks, keys)
    g = g.withColumns({"out_h": F.lit(height), "out_w": F.lit(width),
                       "ay": F.col("src_h") / float(height), "ax": F.col("src_w") / float(width),
                       "cy": F.lit(0.0), "cx": F.lit(0.0)})
    return resample(blocks, g, keys, "nearest", size)


def align_to_grid(blocks, grids, keys=("scene", "band"), size=512):
    """Read bands on a reference grid in the same CRS.

    ``grids`` per key: ``src_transform, src_crs, dst_transform, dst_crs, out_h,
    out_w``.  A missing or different CRS is an error row, and so is a rotated grid.
    """
    keys = list(keys)
    s, d = F.col("src_transform"), F.col("dst_transform")
    straight = (s[1] == 0) & (s[3] == 0) & (d[1] == 0) & (d[3] == 0)
    usable = F.coalesce((F.col("src_crs") == F.col("dst_crs")) & straight, F.lit(False))
    errors = grids.where(~usable).select(
        *keys,
        F.when(
            F.col("src_crs").isNull() | F.col("dst_crs").isNull(),
            "Automatic spatial alignment requires georeferencing.",
        ).when(F.col("src_crs") != F.col("dst_crs"), "CRS differs").otherwise("Grid is rotated.").alias("error"),
    )
    g = grids.where(usable).join(raster_size(blocks, keys), keys).withColumns({
        "ax": d[0] / s[0], "cx": (0.5 * d[0] + d[2] - s[2]) / s[0] - 0.5,
        "ay": d[4] / s[4], "cy": (0.5 * d[4] + d[5] - s[5]) / s[4] - 0.5,
    })
    return resample(blocks, g, keys, "bilinear", size, outside="missing"), errors


def _pixel_id(y, x):
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long"))


def components(masks, keys=("scene",)):
    """8-connected components of set pixels: (keys, component, area).

    Blocks are labelled on their own; components that touch across a block edge
    are then merged by least labels, with pointer jumping, until nothing moves.
    """
    keys = list(keys)
    types = dict(masks.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)

    def label(batches):
        for batch in batches:
            pieces = []
            for r in batch.itertuples(index=False):
                h, w = int(r.h), int(r.w)
                mask = np.asarray(r.data).reshape(h, w) > 0
                if not mask.any():
                    continue
                flat = kernels.block_components(mask)
                ids, areas = np.unique(flat[mask], return_counts=True)
                name = lambda i: ((int(r.by) + i // w).astype(np.int64) << 32) | (int(r.bx) + i % w)
                key = {k: getattr(r, k) for k in keys}
                pieces.append(pd.DataFrame({**key, "comp": name(ids), "area": areas, "y": -1, "x": -1}))
                rim = mask.copy()
                rim[1:-1, 1:-1] = False
                ys, xs = np.nonzero(rim)
                pieces.append(pd.DataFrame({
                    **key, "comp": name(flat[ys, xs]), "area": 0,
                    "y": ys + int(r.by), "x": xs + int(r.bx)}))
            if pieces:
                yield pd.concat(pieces)[[*keys, "comp", "area", "y", "x"]]

    found = reliable_checkpoint(
        masks.select(*keys, "by", "bx", "h", "w", "data").mapInPandas(
            label, f"{fields}, comp long, area long, y int, x int"
        )
    )
    labels = found.where("y < 0").select(*keys, "comp", "area", F.col("comp").alias("label"))
    rim = found.where("y >= 0").select(*keys, "comp", "y", "x")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                      for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    near = rim.select(*keys, F.col("comp").alias("other"), "y", "x", F.explode(steps).alias("s")).select(
        *keys, "other", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")
    )
    edges = reliable_checkpoint(
        rim.join(near, [*keys, "y", "x"]).where("comp <> other").select(*keys, "comp", "other").distinct()
    )
    moving = not edges.isEmpty()
    while moving:
        source = labels.select(*keys, F.col("comp").alias("other"), F.col("label").alias("offer"))
        offers = edges.join(source, [*keys, "other"]).groupBy(*keys, "comp").agg(F.min("offer").alias("offer"))
        lowered = labels.join(offers, [*keys, "comp"], "left").select(
            *keys, "comp", "area", F.least("label", F.coalesce("offer", "label")).alias("new"), F.col("label").alias("old")
        )
        jump = lowered.select(*keys, F.col("comp").alias("new"), F.col("new").alias("next"))
        moved = join_facts(lowered, jump, [*keys, "new"]).select(
            *keys, "comp", "area", F.least("new", "next").alias("label"), "old"
        )
        moved = reliable_checkpoint(moved)
        moving = not moved.where("label <> old").isEmpty()
        labels = moved.drop("old")
    return labels.groupBy(*keys, F.col("label").alias("component")).agg(F.sum("area").alias("area"))


def legacy_mask(diff_blocks, threshold=LEGACY_THRESHOLD):
    """Pixels whose difference exceeds a fixed threshold."""
    return diff_blocks.withColumn("data", F.transform("data", lambda v: F.when(v > threshold, 255).otherwise(0)))


def opened_mask(masks, keys=("scene",), size=512):
    """The legacy mask after a 5x5 opening, as it is saved."""
    return morph(masks, ("min", "max"), keys, size, radius=2)


def mask_quality(masks, registration, keys=("scene",)):
    """Signal, noise, coherence, trust and verdict of each mask.

    ``registration`` has the keys and ``reg_conf``.
    """
    keys = list(keys)
    shares = masks.groupBy(*keys).agg(
        (F.sum(F.size(F.filter("data", lambda v: v > 0))) / F.sum(F.size("data")) * 100).alias("intensity")
    )
    areas = components(masks, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("area") >= SIGNAL_AREA, F.col("area")).otherwise(0)).alias("signal"),
        F.sum(F.when(F.col("area") < SIGNAL_AREA, F.col("area")).otherwise(0)).alias("noise"),
    )
    signal, noise = F.col("signal"), F.col("noise")
    snr = F.round(10 * F.log10(signal / (noise + SNR_NOISE) + SNR_RATIO), 2)
    coherence = F.round(signal / (signal + noise + SNR_NOISE) * 100, 2)
    rows = shares.join(areas, keys, "left").join(registration, keys, "left").select(
        *keys, "intensity", "reg_conf",
        F.coalesce(snr, F.lit(0.0)).alias("snr_db"), F.coalesce(coherence, F.lit(0.0)).alias("coherence"),
    )
    trust = F.col("reg_conf") * TRUST_REGISTRATION + F.col("coherence") / 100 * TRUST_COHERENCE
    return rows.withColumn("trust", trust).withColumn(
        "verdict",
        F.when(F.col("trust") > TRUST_LIMIT, "VERIFIED GEOGRAPHIC CHANGE").otherwise("SIGNAL INCONCLUSIVE"),
    )
