"""Near copies by exact similarity of shingle sets.

SimHash links and a prefix filter propose pairs, parity signatures turn most of
the false ones down, the whole texts decide.
Two sets of a Jaccard similarity of 4/5 share one of the first n // 5 + 1
shingles of each, in any order that all sets use (n is a set's size), so no such
pair is missed; fingerprints alone would need a radius of about ten bits and
more, thousands of covering tables.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from geoquarry.llm.graph import components
from geoquarry.llm.simhash import RADIUS, links, majority, one_of_each, shingle_hashes
from geoquarry.session import reliable_checkpoint

#: Words of a shingle; least similarity of a link as a fraction.
WORDS, LEAST, OF = 5, 4, 5
#: About so many rows show which shingles are common, and at most so many of these are put last in the order.
SAMPLE_ROWS, COMMON = 5_000, 100_000
#: Buckets over this size are compared from the rows outside their largest component only.
LARGE = 512
_SENT = 1 << 16
#: Texts whose shingle sets are held at once.
_TEXTS = 1024
#: Bits of the filter that keeps texts without a candidate pair from being shuffled; once it is full, all are shuffled.
_BITS = 1 << 23
#: Least bits of a parity signature, and of the shorter one that goes along into the buckets.
_PARITY = 1024
#: Columns of the shorter signature, and of the first shingles of a prefix.
_WORDS, _FIRST = [f"p{k}" for k in range(_PARITY // 64)], [f"h{k}" for k in range(8)]


def shingle_set(text, words=WORDS):
    """The distinct XXH64 hashes of the word shingles, sorted; of one shorter shingle where there are fewer words."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _flat(lists, kind):
    """A list column of ``kind`` from arrays."""
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.uint64), *lists]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def common_shingles(docs, text_col="text"):
    """(hashes, counts) of shingles that several sampled rows have, sorted by hash: bounded, and only a matter of speed."""
    modulus = max(1, docs.count() // SAMPLE_ROWS)

    def spread(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py() or "").view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(modulus)) == 0).select(text_col).mapInArrow(spread, "h long")
    usual = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    h, n = usual["h"].to_numpy(np.int64).view(np.uint64), usual["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes, common):
    """The first len // 5 + 1 of a set's ``hashes``, common ones last."""
    known, count = common
    rank = np.zeros(len(hashes), np.int64)
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, count[at], 0)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - -(-LEAST * len(hashes) // OF) + 1]]


def parity(hashes):
    """A signature of a set with a power of two of bits, 2n at least: how many hashes fall on each bit, modulo two."""
    bits = max(_PARITY, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else _PARITY
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little")


def folded(signature, bytes_):
    """The signature of the same set with fewer bits."""
    return np.bitwise_xor.reduce(signature.reshape(-1, bytes_), axis=0)


def may_be_similar(n, one, other_n, other):
    """Can sets of these sizes and signatures have the similarity?  A bit that differs is at least one hash that does.

    With a Jaccard similarity of LEAST / OF, at most (OF - LEAST) / (OF + LEAST) of all hashes of both sets are in one only.
    """
    one, other = (np.frombuffer(x, np.uint8) for x in (one, other))
    size = min(len(one), len(other))
    differ = int(np.bitwise_count(folded(one, size) ^ folded(other, size)).sum())
    return (OF + LEAST) * differ <= (OF - LEAST) * (n + other_n)


def prints(docs, id_col="doc_id", text_col="text"):
    """Of each row ``doc_id``, ``body`` (a hash of the text), ``node`` (a hash of the shingle set), ``n`` (its size), ``fp``, ``sig`` (its prefix), ``par``."""
    common = common_shingles(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        # few texts at a time: their sets are larger than they are
        for batch in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
            sets = [shingle_set(t.as_py() or "") for t in batch.column(1)]
            node, fp = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (lambda s: xxhash.xxh64_intdigest(s.tobytes()), lambda s: majority([s])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), _flat([prefix(s, common) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "body", "node", "n", "fp", "sig", "par"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, body long, node long, n long, fp long, sig array<long>, par binary")


def possible(n, at, other_n, other_at):
    """Can sets of sizes ``n`` and ``other_n`` be similar whose first common shingle has these places in their orders?"""
    alike = OF * np.minimum(n, other_n) >= LEAST * np.maximum(n, other_n)
    return alike & ((LEAST + OF) * np.minimum(n - at, other_n - other_at) >= LEAST * (n + other_n))


def _columns(batch):
    return np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)]).astype(np.int64)


def in_company(batches):
    """Of rows (key, node, n * 2**32 + pos, ...) sorted by key and node those that share a key with other nodes, once.

    Each has the node before it as ``prev`` if they can be similar.
    """

    def sent(part, a, b):
        left = np.r_[False, part[0, 1:] == part[0, :-1]]
        at = np.arange(a, b)[(left | np.r_[left[1:], False])[a:b]]
        key, node, n, pos = part[:4, at]
        ok = left[at] & possible(n, pos, part[2, at - 1], part[3, at - 1])
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, node, n, pos)), pa.array(part[1, at - 1], pa.int64(), mask=~ok)], names=["key", "node", "n", "pos", "prev"])

    # the last row waits for the next one, and the row before it was sent
    held, waits = None, 0
    for batch in batches:
        part = _columns(batch)[:3]
        part = np.vstack([part[:2], part[2] >> 32, part[2] & 0xFFFFFFFF])
        part = part if held is None else np.hstack([held, part])
        if part.shape[1]:
            part = part[:, np.r_[True, (part[:2, 1:] != part[:2, :-1]).any(0)]]
            yield sent(part, waits, part.shape[1] - 1)
            held = part[:, -2:]
            waits = held.shape[1] - 1
    if held is not None:
        yield sent(held, waits, held.shape[1])


def short_signature(column):
    """The words of a parity signature folded to _PARITY bits, as the long columns ``_WORDS``."""

    def run(batches):
        for batch in batches:
            words = [folded(np.frombuffer(x, np.uint8), _PARITY // 8).view(np.int64) for x in batch.column(1).to_pylist()]
            words = np.array(words, np.int64).reshape(-1, len(_WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, words.T)], names=["node", *_WORDS])

    return column.mapInArrow(run, ", ".join(f"{c} long" for c in ["node", *_WORDS]))


def pairs_across(batches):
    """Of rows (key, n, node, pos, root, *_WORDS, *_FIRST) sorted by key and n the pairs of one key and two roots that can be similar.

    A pair that meets under many keys is given for the first one only, in the
    order that all sets use, if it is one of the first few of both prefixes.
    """
    rest = None
    for batch in batches:
        part = _columns(batch)
        part = part if rest is None else np.hstack([rest, part])
        if not part.shape[1]:
            continue
        last = np.searchsorted(part[0], part[0, -1])
        yield from _across(part[:, :last])
        rest = part[:, last:]
    if rest is not None:
        yield from _across(rest)


def _across(part):
    if not part.shape[1]:
        return
    key, n, node, pos, root = part[:5]
    words, firsts = part[5 : 5 + len(_WORDS)].view(np.uint64), part[5 + len(_WORDS) :]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)

    def rows(i, j):
        ok = (root[i] != root[j]) & possible(n[i], pos[i], n[j], pos[j])
        i, j = i[ok], j[ok]
        differ = np.zeros(len(i), np.int64)
        # most pairs differ in too many of the first bits already
        for at in range(0, len(words), 4):
            differ += np.bitwise_count(words[at : at + 4, i] ^ words[at : at + 4, j]).sum(0, dtype=np.int64)
            ok = (OF + LEAST) * differ <= (OF - LEAST) * (n[i] + n[j])
            i, j, differ = i[ok], j[ok], differ[ok]
        met = key[i]
        for h in firsts[::-1, i]:
            met = np.where((h == firsts[:, j]).any(0), h, met)
        ok = met == key[i]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])[ok]), pa.array(np.maximum(node[i], node[j])[ok])], names=["a", "b"])

    for a, m in zip(first[mixed & (size > LARGE)], size[mixed & (size > LARGE)]):
        names, count = np.unique(root[a : a + m], return_counts=True)
        every = np.arange(a, a + m)
        inside = root[a : a + m] == names[count.argmax()]
        for i in every[~inside]:
            # two that are both outside meet once
            others = every[inside | (every > i)]
            yield rows(np.full(len(others), i), others)
    i = np.flatnonzero(np.repeat(mixed & (size <= LARGE), size))
    for step in range(1, LARGE):
        i = i[i + step < len(key)]
        # rows of a key are sorted by size: once the other is too large, all later ones are
        i = i[(key[i] == key[i + step]) & (OF * n[i] >= LEAST * n[i + step])]
        if not len(i):
            return
        for at in range(0, len(i), _SENT):
            yield rows(i[at : at + _SENT], i[at : at + _SENT] + step)


def _ordered(pairs):
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs, plain):
    """The pairs (a, b) that signatures do not turn down; ``plain`` has ``node, n, par``."""
    one, two = (plain.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("par").alias(f"par_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "par_a", "n_b", "par_b")

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            ok = pa.array([may_be_similar(*row) for row in zip(*columns)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    return both.mapInArrow(run, "a long, b long")


def candidate_bits(bodies):
    """A filter of ``bodies`` as bytes; its words are combined on the executors, so at most ``_BITS`` bits reach the driver."""
    low = F.col("body").bitwiseAND(F.lit(_BITS - 1))
    word = bodies.select(F.shiftright(low, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(body & 63 AS int))").alias("bit"))
    rows = word.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(_BITS // 64, np.int64)
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def verified(pairs, plain, docs, text_col="text"):
    """The pairs (a, b) whose whole texts have the similarity; ``plain`` has each node's least ``body``.

    A text is sent once by its hash and once for each pair in which it is the
    larger node, and its shingles are made where both texts are.
    """
    named = reliable_checkpoint(
        pairs.join(plain.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(plain.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    )
    bits = docs.sparkSession.sparkContext.broadcast(candidate_bits(named.select(F.col("body_a").alias("body")).union(named.select("body_b"))))

    def wanted(batches):
        held = bits.value
        for batch in batches:
            at = batch.column(0).to_numpy() & (_BITS - 1)
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    texts = docs.select(F.xxhash64(text_col).alias("body"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(wanted, "body long, text string")
    single = texts.dropDuplicates(["body"])
    one, two = (single.select(F.col("body").alias(f"body_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    # rows of one first text come together
    both = named.join(two, "body_b").join(one, "body_a").select("a", "b", "body_a", "text_a", "text_b")

    def run(batches):
        last, own = None, None
        for batch in batches:
            ok = []
            for i, body in enumerate(batch.column(2).to_pylist()):
                if body != last:
                    last, own = body, shingle_set(batch.column(3)[i].as_py())
                other = shingle_set(batch.column(4)[i].as_py())
                shared = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(OF * shared >= LEAST * (len(own) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar_links(docs, found, text_col="text"):
    """Verified links between nodes of ``found`` (:func:`prints`) that connect just what all similar pairs connect.

    First each node meets a few others: those that SimHash links, and in the
    bucket of each shingle of its prefix one neighbour in a random order.  Then
    all pairs of a bucket that can be similar and are not connected yet follow,
    so that a group of many near copies has no square of pairs.  Each time
    parity signatures, a hundredth of a text, decide which pairs' texts are sent.
    """
    rows = found.select("node", "n", F.posexplode("sig").alias("pos", "key")).select("key", "node", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))
    # copies of a set come next to each other, so that one of them goes on
    near = reliable_checkpoint(
        rows.repartition("key").withColumn("turn", F.xxhash64("node", "key")).sortWithinPartitions("key", "turn", "node")
        .mapInArrow(in_company, "key long, node long, n long, pos long, prev long")
    )
    plain = reliable_checkpoint(
        found.where("n > 0").groupBy("node").agg(F.min("body").alias("body"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.max("par").alias("par"), F.min(F.slice("sig", 1, len(_FIRST))).alias("first"))
    )
    heads = plain.groupBy("fp").agg(F.min("node").alias("head"))
    linked = (
        links(heads.select("fp"), RADIUS)
        .join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
        .join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
        .select("x", "y")
    )
    pairs = reliable_checkpoint(_ordered(
        near.where("prev is not null").select(F.col("node").alias("a"), F.col("prev").alias("b"))
        .union(plain.join(heads, "fp").select("node", "head")).union(linked)
    ))
    sure = reliable_checkpoint(verified(likely(pairs, plain), plain, docs, text_col))
    stars = components(sure).withColumnRenamed("a", "node").withColumnRenamed("b", "top")
    # a shorter prefix repeats its first shingle
    firsts = plain.select("node", *[F.coalesce(F.get("first", F.lit(k)), F.get("first", F.lit(0))).alias(c) for k, c in enumerate(_FIRST)])
    known = short_signature(plain.select("node", "par")).join(firsts, "node").join(stars, "node", "left").select("node", F.coalesce("top", "node").alias("root"), *_WORDS, *_FIRST)
    placed = near.join(known, "node").select("key", "n", "node", "pos", "root", *_WORDS, *_FIRST)
    others = placed.repartition("key").sortWithinPartitions("key", "n").mapInArrow(pairs_across, "a long, b long")
    more = likely(_ordered(others), plain)
    return sure.union(verified(more, plain, docs, text_col))


def representatives(docs, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` with one row of each group of near copies: the smallest id (null last), then the smallest text hash.

    A group is what links of a five-word Jaccard similarity of 4/5 or more
    connect.  Sets are compared by the 64-bit hashes of their shingles, and equal
    sets meet as one by a 64-bit hash.  Texts without words (also null) are alike;
    a text of fewer than five words is one shingle; an empty table gives no rows.
    """
    found = reliable_checkpoint(prints(docs, id_col, text_col))
    stars = components(similar_links(docs, found, text_col)).withColumnRenamed("a", "node")
    rooted = found.select("doc_id", "body", "node").join(stars, "node", "left").select("doc_id", "body", F.coalesce("b", "node").alias("root"))
    return one_of_each(docs, rooted, id_col, text_col)
