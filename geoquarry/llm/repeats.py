"""Removal of repeated byte strings by bucket-pointer refinement over anchored suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document of a smaller id.  Sorting every suffix would move many times the text,
so only anchors are sorted at first: the least hash among the q-grams of a
window marks the same place wherever the window occurs, about every sixteenth
place.  Initial q-gram buckets of anchors that two documents share go on; their
surroundings are then refined by sorting on the bucket identifiers of later
offsets (8 to 16 to 32 to all bytes, each round built from the identifiers of
the one before) until equal windows, and only those, share a bucket.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from geoquarry.llm.bytegrams import gram_hashes, sliding_min
from geoquarry.llm.common import shuffle_partitions, table

#: Bytes of a repeated string, bytes of an initial bucket's gram.
LENGTH, GRAM = 50, 20
#: q-grams in a window, and bytes around an anchor that its windows can cover.
PLACES = LENGTH - GRAM + 1
AROUND = 2 * LENGTH - GRAM
#: Bytes handled at once, and bytes of text that share a part of the buckets.
PIECE, PART_BYTES = 1 << 20, 16 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def pieces(rows):
    """Buffers of about ``PIECE`` bytes from (row, bytes): (buffer, row of each piece, its start in the row, its length).

    Long texts are cut with an overlap of LENGTH - 1 bytes, so that every window
    lies in exactly one piece.
    """
    held, total = [], 0
    for row, body in rows:
        for at in range(0, len(body) - LENGTH + 1, PIECE):
            part = body[at : at + PIECE + LENGTH - 1]
            held.append((row, at, part))
            total += len(part)
            if total >= PIECE:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    rows, starts, parts = zip(*held)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(starts), np.array([len(p) for p in parts])


def windows(buffer, lengths):
    """(least hash of each window, piece of each place, whether a window fits there) over a buffer of pieces."""
    least = sliding_min(gram_hashes(buffer, GRAM), PLACES)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    fits = piece[: len(least)] == piece[LENGTH - 1 : LENGTH - 1 + len(least)]
    return least, piece[: len(least)], fits


def first_least(hashes):
    """Place of the first least hash among each PLACES neighbours."""
    value, place, have = hashes, np.arange(len(hashes)), 1
    while have < PLACES:
        step = min(have, PLACES - have)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        have += step
    return place


def runs(changed):
    """First and last index of the runs that ``changed`` (true where one begins) cuts."""
    first = np.flatnonzero(changed)
    return first, np.r_[first[1:], len(changed)] - 1


def part_of(hashes, parts):
    # the least of many hashes has small high bits, so the low ones tell parts apart
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32)


def _texts(batch, skip):
    """(row, bytes) of the rows that take part; ``skip`` is the column of texts that are copies, by their short hash."""
    short = batch.column("short").to_pylist()
    for i, (text, copies) in enumerate(zip(batch.column("bytes"), skip.to_pylist())):
        if copies is None or short[i] not in copies:
            yield i, text.as_py() or b""


def anchors(parts):
    """Pass one: the initial buckets of each document's anchors, combined within a buffer.

    Kind 0 is (bucket, id) of a bucket that one id has here; kind 1 a bucket that
    several have, sent once; kind 2 (bucket, id) of those, known to be shared, and
    sent to a part by id.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for buffer, rows, _, lengths in pieces(_texts(batch, batch.column("copies"))):
                least, piece, fits = windows(buffer, lengths)
                least, owner = least[fits], ids[rows[piece[fits]]]
                first, _ = runs(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
                h, doc = least[first], owner[first]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                single = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                h, doc = h[single], doc[single]
                a, b = runs(np.r_[True, h[1:] != h[:-1]])
                several = a < b
                many = np.repeat(several, b - a + 1)
                yield from _send(0, h[~many], doc[~many], part_of(h[~many], parts))
                yield from _send(1, h[a[several]], None, part_of(h[a[several]], parts))
                yield from _send(2, h[many], doc[many], (doc[many] % parts).astype(np.int32))

    return run


def _send(kind, h, doc, part):
    if not len(h):
        return
    # by id within a part, so that ids compress
    order = np.lexsort((h, doc, part)) if doc is not None else np.lexsort((h, part))
    h, part = h[order], part[order]
    first, last = runs(np.r_[True, part[1:] != part[:-1]])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(part[first]), pa.array(np.full(len(first), kind, np.int8)), _blobs(h, first, last),
            _blobs(doc[order], first, last) if doc is not None else pa.array([None] * len(first), pa.binary()),
        ],
        names=["part", "kind", "h", "doc"],
    )


def _blobs(values, first, last):
    """A binary column whose rows are runs of ``values``."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    offsets = np.r_[first, last[-1] + 1].astype(np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _whole(column, kind):
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def shared_anchors(rows):
    """The buckets of a part that two ids or more share: (id, bucket)."""
    kinds = rows["kind"].to_numpy()
    own = rows.filter(pa.array(kinds == 0))
    h, doc = _whole(own["h"], np.uint64), _whole(own["doc"], np.int64)
    several = np.unique(_whole(rows.filter(pa.array(kinds == 1))["h"], np.uint64))
    known = rows.filter(pa.array(kinds == 2))
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    out_h, out_doc = [_whole(known["h"], np.uint64)], [_whole(known["doc"], np.int64)]
    if len(h):
        a, b = runs(np.r_[True, h[1:] != h[:-1]])
        shared = np.minimum.reduceat(doc, a) != np.maximum.reduceat(doc, a)
        if len(several):
            at = np.minimum(np.searchsorted(several, h[a]), len(several) - 1)
            shared |= several[at] == h[a]
        keep = np.repeat(shared, b - a + 1)
        out_h.append(h[keep])
        out_doc.append(doc[keep])
    return pa.table({"doc_id": np.concatenate(out_doc), "h": np.concatenate(out_h).view(np.int64)})


_ROW_MULS = np.random.default_rng(99).integers(0, 2**63, (2, AROUND // 8 + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_hashes(h, span, around):
    """Two 64-bit hashes of each row of bucket, span and surroundings."""
    words = around.view(np.uint64)
    out = []
    for muls in _ROW_MULS:
        x = h * muls[0] + span * muls[1]
        for k in range(words.shape[1]):
            x ^= x >> np.uint64(31)
            x = x * muls[0] + words[:, k] * muls[k + 2]
        out.append(x ^ (x >> np.uint64(29)))
    return out


def surroundings(parts):
    """Pass two: for each shared anchor, the bytes its windows cover, with the id and place they come from.

    Within a buffer, equal surroundings of a larger id are known to be repeats at
    once (kind 1: the covered window starts); the others go to their part.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, short = batch.column("doc_id").to_numpy(), batch.column("short").to_numpy()
            lists = batch.column("shared")
            for buffer, rows, starts, lengths in pieces(_texts(batch, batch.column("copies"))):
                hashes = gram_hashes(buffer, GRAM)
                place = first_least(hashes)
                piece = np.repeat(np.arange(len(lengths)), lengths)
                fits = piece[: len(place)] == piece[LENGTH - 1 : LENGTH - 1 + len(place)]
                at = np.flatnonzero(fits)
                first, last = runs(np.r_[True, (place[at][1:] != place[at][:-1]) | (piece[at][1:] != piece[at][:-1])])
                s, e = at[first], at[last]
                a, of = place[s], piece[s]
                h = hashes[a]
                keep = np.zeros(len(h), bool)
                for lo, hi in zip(*runs(np.r_[True, of[1:] != of[:-1]])):
                    shared = lists[int(rows[of[lo]])].values.to_numpy().view(np.uint64)
                    keep[lo : hi + 1] = np.isin(h[lo : hi + 1], shared)
                if not keep.any():
                    continue
                s, e, a, of, h = s[keep], e[keep], a[keep], of[keep], h[keep]
                low, high = s - (a - PLACES + 1), e - (a - PLACES + 1)
                spots = np.arange(AROUND)
                where = (a - PLACES + 1)[:, None] + spots
                around = buffer[np.clip(where, 0, len(buffer) - 1)]
                around[(spots < low[:, None]) | (spots >= high[:, None] + LENGTH)] = 0
                start = (starts[of] + s - np.concatenate(([0], np.cumsum(lengths)[:-1]))[of]).astype(np.int64)
                doc, tag = ids[rows[of]], short[rows[of]]
                span = (low * 32 + high).astype(np.uint64)
                one, two = row_hashes(h, span, around)
                order = np.lexsort((doc, two, one))
                fresh = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
                lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
                repeat = np.zeros(len(order), bool)
                repeat[order] = doc[order] > doc[lead]
                packed = start * 256 + (high - low)
                if repeat.any():
                    yield _spans(doc[repeat], tag[repeat], packed[repeat])
                left = np.flatnonzero(~repeat)
                part = part_of(h[left], parts)
                left = left[np.lexsort((start[left], doc[left], part))]
                part = part_of(h[left], parts)
                lo, hi = runs(np.r_[True, part[1:] != part[:-1]])
                head = np.stack([h[left].view(np.int64), span[left].view(np.int64), doc[left], tag[left].astype(np.int64), packed[left]])
                blobs = [squeeze.compress(np.ascontiguousarray(head[:, x : y + 1]).tobytes()) for x, y in zip(lo, hi)]
                texts = [squeeze.compress(around[left[x : y + 1]].tobytes()) for x, y in zip(lo, hi)]
                n = len(lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[lo]), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                    names=_SENT,
                )

    def _spans(doc, tag, packed):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array((doc % parts).astype(np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(doc), pa.array(tag), pa.array(packed)],
            names=_SENT,
        )

    return run


_SENT = ["part", "head", "around", "doc_id", "short", "span"]
_SENT_TYPE = "part int, head binary, around binary, doc_id long, short int, span long"


def refined(around):
    """Bucket identifier of the LENGTH bytes from each of the first PLACES offsets of each row, equal for equal strings.

    Exact: eight bytes are their own identifier; each round sorts the pairs of an
    offset's identifier and that of a later offset, whose numbers are the
    identifiers of strings twice as long, and the next round uses these.
    """
    n = len(around)
    ids = np.lib.stride_tricks.sliding_window_view(around, 8, axis=1)
    ids = np.ascontiguousarray(ids).view(np.uint64).reshape(n, -1)
    ids = np.unique(ids, return_inverse=True)[1].reshape(n, -1)
    for later in (8, 16, LENGTH - 32):
        pair = ids[:, : ids.shape[1] - later] * (int(ids.max()) + 1) + ids[:, later:]
        ids = np.unique(pair, return_inverse=True)[1].reshape(n, -1)
    return ids


def covered(rows):
    """Window starts of a part that a smaller id has too: ``doc_id``, ``short``, ``span`` (first start * 256 + how many more)."""
    sent = rows.filter(pa.array(rows["head"].is_valid()))
    open_ = zstandard.ZstdDecompressor()
    heads = [np.frombuffer(open_.decompress(x), np.int64).reshape(5, -1) for x in sent["head"].to_pylist()]
    direct = rows.filter(pa.array(rows["doc_id"].is_valid()))
    out = [[direct["doc_id"].to_numpy()], [direct["short"].to_numpy()], [direct["span"].to_numpy()]]
    if heads:
        head = np.hstack(heads)
        around = np.frombuffer(b"".join(open_.decompress(x) for x in sent["around"].to_pylist()), np.uint8).reshape(-1, AROUND)
        del heads
        for x, y in zip(out, _part_spans(head, around)):
            x.append(y)
    return pa.table({"doc_id": np.concatenate(out[0]), "short": np.concatenate(out[1]).astype(np.int32), "span": np.concatenate(out[2])})


def _part_spans(head, around):
    h, span, doc, tag, packed = head[0].view(np.uint64), head[1].view(np.uint64), head[2], head[3], head[4]
    one, two = row_hashes(h, span, around)
    order = np.lexsort((doc, two, one, h))
    h, span, doc, tag, packed = h[order], span[order], doc[order], tag[order], packed[order]
    one, two = one[order], two[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    kind = np.cumsum(fresh) - 1
    leads = np.flatnonzero(fresh)
    least = doc[leads]
    later = doc > least[kind]
    out = [(doc[later], tag[later], packed[later])]
    # buckets of one kind of surroundings are settled; the others are refined, by their leads
    lead_h = h[leads]
    a, b = runs(np.r_[True, lead_h[1:] != lead_h[:-1]])
    open_ = np.flatnonzero(np.repeat(a < b, b - a + 1))
    if len(open_):
        limit = max(1, (1 << 23) // AROUND)
        bucket = np.repeat(np.arange(len(a)), b - a + 1)[open_]
        cuts = [0]
        # whole buckets at a time, as many as fit
        ends = runs(np.r_[True, bucket[1:] != bucket[:-1]])[1] + 1
        for end in ends:
            if end - cuts[-1] > limit and len(cuts) and end != ends[0]:
                cuts.append(int(previous))
            previous = end
        cuts = sorted({*cuts, len(open_)})
        starts = np.r_[leads, len(h)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            some = open_[x:y]
            places = refined(around[order[leads[some]]])
            low, high = (span[leads[some]] // np.uint64(32)).astype(int), (span[leads[some]] % np.uint64(32)).astype(int)
            offset = np.arange(PLACES)
            inside = (offset >= low[:, None]) & (offset <= high[:, None])
            row, col = np.nonzero(inside)
            key, own = places[row, col] * PLACES + col, least[some][row]
            rank = np.lexsort((own, key, bucket[x:y][row]))
            begin = np.r_[True, (key[rank][1:] != key[rank][:-1]) | (bucket[x:y][row][rank][1:] != bucket[x:y][row][rank][:-1])]
            smallest = own[rank][np.maximum.accumulate(np.where(begin, np.arange(len(rank)), 0))]
            hit = np.zeros(inside.shape, bool)
            hit[row[rank], col[rank]] = smallest < own[rank]
            # runs of covered starts of a lead hold for all places of its least id
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, c = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            k = some[r]
            counts = np.array([np.searchsorted(doc[starts[i] : starts[i + 1]], least[i], "right") for i in k], dtype=np.int64)
            at = np.repeat(starts[k], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            first = packed[at] // 256 + np.repeat(c - low[r], counts)
            out.append((doc[at], tag[at], first * 256 + np.repeat(stop - c - 1, counts)))
    return [np.concatenate(x) for x in zip(*out)]


def removed(body, spans):
    """(bytes removed, maximal removed runs, SHA-256 of the rest) for covered window starts ``spans``."""
    if not len(spans):
        return 0, 0, hashlib.sha256(body).hexdigest()
    spans = np.unique(spans)
    start, stop = spans // 256, spans // 256 + spans % 256 + LENGTH
    reach = np.maximum.accumulate(stop)
    first = np.r_[True, start[1:] > reach[:-1]]
    a = start[first]
    b = reach[np.r_[np.flatnonzero(first)[1:] - 1, len(reach) - 1]]
    left, at = hashlib.sha256(), 0
    view = memoryview(body)
    for x, y in zip(a.tolist(), b.tolist()):
        left.update(view[at:x])
        at = y
    left.update(view[at:])
    return int((b - a).sum()), len(a), left.hexdigest()


def keep(batches):
    """Last pass: the result row of each document."""
    for batch in batches:
        rows = []
        short = batch.column("short").to_pylist()
        copies, spans = batch.column("copies").to_pylist(), batch.column("spans")
        for i, value in enumerate(batch.column("bytes")):
            body = value.as_py() or b""
            if copies[i] is not None and short[i] in copies[i] and len(body) >= LENGTH:
                rows.append((len(body), len(body), 1, _EMPTY))
                continue
            found = np.empty(0, np.int64)
            if spans[i].is_valid:
                both = spans[i].values
                found = both.field("span").to_numpy()[both.field("short").to_numpy() == short[i]]
            rows.append((len(body), *removed(body, found)))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs, id_col="doc_id", text_col="text"):
    """What repeats of smaller ids leave of each whole text, as UTF-8 bytes.

    Output: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256``.  The text is shuffled once, by id, and that shuffle serves
    all three passes.  Exact copies of a smaller id's text are settled first by
    their hash and take no further part.  Whatever is sent to a part of the
    buckets is combined within a buffer first, so a string that is everywhere
    arrives once per buffer.

    Ids are whole numbers; rows of one id do not repeat each other, and a row
    without an id takes no part and stays whole.  A null text is empty; texts
    shorter than the string stay; an empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"), F.hash(text_col).alias("short")
    )
    placed = rows.where(F.col("doc_id").isNotNull()).repartition("doc_id")
    # how many parts: from the bytes of all texts
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), -(-total // PART_BYTES))
    short = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("short"), F.md5(text_col).alias("body")).where(
        F.col("doc_id").isNotNull() & F.col("body").isNotNull()
    )
    least = short.groupBy("body").agg(F.min("doc_id").alias("least")).withColumnRenamed("body", "b")
    copies = short.join(least, F.col("body") == F.col("b")).where(F.col("doc_id") > F.col("least")).groupBy("doc_id").agg(
        F.collect_set("short").alias("copies")
    )
    flagged = placed.join(copies, "doc_id", "left")
    names = ("doc_id", "bytes", "short", "copies")
    buckets = flagged.select(*names).mapInArrow(anchors(parts), "part int, kind byte, h binary, doc binary")
    shared = buckets.groupBy("part").applyInArrow(shared_anchors, "doc_id long, h long").groupBy("doc_id").agg(F.collect_list("h").alias("shared"))
    near = flagged.join(shared, "doc_id").select(*names, "shared").mapInArrow(surroundings(parts), _SENT_TYPE)
    spans = near.groupBy("part").applyInArrow(covered, "doc_id long, short int, span long").groupBy("doc_id").agg(
        F.collect_list(F.struct("short", "span")).alias("spans")
    )
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = rows.where(F.col("doc_id").isNull()).select("doc_id", "bytes", "short")
    nothing = whole.select("*", F.lit(None).cast("array<int>").alias("copies"), F.lit(None).cast("array<struct<short:int,span:bigint>>").alias("spans"))
    judged = flagged.join(spans, "doc_id", "left").select(*names, "spans")
    return judged.mapInArrow(keep, out).unionByName(nothing.mapInArrow(keep, out))


def op2_repeats(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))
