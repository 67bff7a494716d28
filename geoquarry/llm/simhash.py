"""Near duplicates by SimHash and covering locality-sensitive hashing."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from geoquarry.llm.common import table, under_own_names
from geoquarry.llm.graph import components
from geoquarry.session import reliable_checkpoint

#: Words of a shingle, seed of its hash, most differing bits of a link.
WORDS, SEED, RADIUS = 3, 42, 2
#: Buckets up to this size are compared by all their pairs, larger ones by looking up every neighbour.
PAIRWISE = 512
_AT_ONCE = 1 << 16


def shingle_hashes(text, words=WORDS):
    """XXH64 of each word shingle of the lower-cased text, in order, as parts of bounded length."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _AT_ONCE):
        pairs = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(parts):
    """Majority of the bits of the hashes in ``parts``, as an unsigned number; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text, words=WORDS):
    """Majority of the XXH64 bits of the word shingles, as an unsigned number; 0 without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs, id_col="doc_id", text_col="text", words=WORDS):
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a long) and ``body`` (a hash of the text) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], names=["doc_id", "fp", "body"])

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(prints, f"doc_id {kind}, fp long, body long")


def covering_masks(radius=RADIUS):
    """Bit masks of which, for any ``radius`` or fewer differing bits, some mask keeps none.

    Bit i carries a non-zero vector of radius + 1 bits; the mask of each non-zero
    vector v keeps the bits whose own vector has an odd product with v.  Up to
    ``radius`` vectors do not span all radius + 1 dimensions, so some v is
    orthogonal to all of them: its mask keeps none of the differing bits.
    """
    n = (1 << (radius + 1)) - 1
    own = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (own[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def local_components(values, radius=RADIUS):
    """For sorted, distinct ``values`` (uint64) of one bucket: the first member of each one's component."""
    n = len(values)
    label = np.arange(n)

    def merge(i, j):
        nonlocal label
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            apart = a != b
            if not apart.any():
                return
            # hang the larger label on the smaller, then shorten the ways
            np.minimum.at(label, np.maximum(a, b)[apart], low[apart])
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter

    if n <= PAIRWISE:
        i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius, 1))
        merge(i, j)
        return label
    differ = values ^ values[0]
    free = [k for k in range(64) if int(np.bitwise_or.reduce(differ)) >> k & 1]
    for size in range(1, radius + 1):
        for bits in combinations(free, size):
            other = values ^ np.uint64(sum(1 << b for b in bits))
            at = np.searchsorted(values, other)
            found = at < n
            found[found] = values[at[found]] == other[found]
            i = np.flatnonzero(found)
            merge(i, at[i])
    return label


def links(prints, radius=RADIUS):
    """Links (a, b) that connect just what the pairs within ``radius`` bits connect.

    ``prints`` has distinct ``fp``.  Each goes to one bucket of every covering
    table; the rows of a bucket arrive sorted, one bucket after another, and a
    bucket gives at most one link a member: to the first of its local component.
    No pair list of a bucket is made or stored.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("at")).select("at.t", "at.key", "fp")

    def connect(batches):
        rest = None
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            part = part if rest is None else np.hstack([rest, part])
            if not part.shape[1]:
                continue
            new = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])) + 1
            last = new[-1] if len(new) else 0
            yield within(part[:, :last], np.r_[0, new[:-1]] if len(new) else new)
            rest = part[:, last:]
        if rest is not None:
            yield within(rest, np.array([0]))

    def within(part, starts):
        out = []
        ends = np.r_[starts[1:], part.shape[1]] if len(starts) else starts
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            values = np.sort(part[2, a:b].view(np.uint64))
            label = local_components(values, radius)
            moved = label != np.arange(len(values))
            out.append(np.stack([values[label[moved]], values[moved]]).view(np.int64))
        found = np.hstack(out) if out else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(connect, "a long, b long")


def near_duplicates(docs, id_col="doc_id", text_col="text", words=WORDS, radius=RADIUS):
    """``doc_id``, ``fp``, ``body`` and ``component_id`` of each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and a
    component is named by the smallest id in it (null if it has none).  Rows of
    one fingerprint meet as one: only distinct fingerprints are compared.  A text
    without words (also null) has the fingerprint 0, linked like any other;
    repeated rows share all results; an empty table gives no rows; other columns
    are not read.
    """
    found = _rooted(docs, id_col, text_col, words, radius)
    return found.select("doc_id", "fp", "body", "component_id")


def _rooted(docs, id_col, text_col, words, radius):
    """:func:`near_duplicates` with ``root``, the fingerprint that stands for the component."""
    prints = reliable_checkpoint(fingerprints(docs, id_col, text_col, words))
    nodes = reliable_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(links(nodes, radius))
    rooted = nodes.join(stars, F.col("fp") == F.col("a"), "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(names, "root").select(F.col("fp").alias("k"), "component_id", "root")
    return prints.join(known, F.col("fp") == F.col("k")).select("doc_id", "fp", "body", "component_id", "root")


def representatives(docs, id_col="doc_id", text_col="text", words=WORDS, radius=RADIUS):
    """The rows of ``docs`` with one row of each component: the smallest id (null last), then the smallest text hash.

    Of rows that agree in id and text the smallest row stays.
    """
    return one_of_each(docs, _rooted(docs, id_col, text_col, words, radius), id_col, text_col)


def one_of_each(docs, found, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` that stand for the groups ``root`` of ``found`` (``doc_id``, ``body``, ``root``); its columns may have any name."""
    return under_own_names(docs, [id_col, text_col], lambda own, i, t: _one_of_each(own, found, i, t))


def _one_of_each(docs, found, id_col, text_col):
    alike = found.groupBy("root", "doc_id", "body").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body", "n")).alias("r"))
    chosen = first.select(F.col("r.doc_id").alias("_r_id"), F.col("r.body").alias("_r_body"), F.col("r.n").alias("_r_n"))
    names = docs.columns
    own = docs.withColumn("_r_own", F.xxhash64(text_col)).join(chosen, F.col(id_col).eqNullSafe(F.col("_r_id")) & (F.col("_r_own") == F.col("_r_body")))
    single = own.where(F.col("_r_n") == 1).select(*names)
    several = own.where(F.col("_r_n") > 1).groupBy("_r_id", "_r_body").agg(F.min(F.struct(*names)).alias("_r_row")).select("_r_row.*")
    return single.unionByName(several)


def op3_simhash(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
