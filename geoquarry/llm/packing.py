"""Packing token sequences by minimum bin slack."""

import re
import struct
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from geoquarry.llm.common import running_totals, table
from geoquarry.session import reliable_checkpoint

CAPACITY, END = 2048, 1
#: Distinct chunks, and distinct words, whose ids a worker remembers at once.
REMEMBERED = 600_000

#: Byte-level vocabularies name printable bytes by themselves and the others by code points from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = [chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]
_CHUNK = re.compile(r"[^ \t\n\r]+")


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters the short way covers: ASCII and the Latin-1 letters, whose lower case and composed form are themselves simple.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How this tokenizer cuts lower-case plain text into words (its own pattern, for those characters).
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class ChunkTokens:
    """Ids of a text from the ids of its chunks between blanks.

    This tokenizer cuts at every white space and drops it, so a text's ids are
    those of its chunks in a row.  Chunks and words repeat, and are encoded once
    while they are remembered.  Words of plain characters go straight to the
    tokenizer's merges; anything else takes its whole way.
    """

    def __init__(self, path, remembered=REMEMBERED):
        from tokenizers import Tokenizer

        self.encoder, self.known, self.words, self.remembered = Tokenizer.from_file(path), {}, {}, remembered
        self.merges = self.encoder.model

    def _word(self, word):
        ids = [t.id for t in self.merges.tokenize("".join(map(_BYTE_NAMES.__getitem__, word.encode())))]
        self.words[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _chunk(self, chunk):
        if not _PLAIN.fullmatch(chunk) or "<|" in chunk:
            ids = self.encoder.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in _WORDS.findall(chunk.lower())])

    def ids(self, text):
        """Little-endian unsigned 32-bit ids, as bytes."""
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        if len(self.words) > self.remembered:
            self.words.clear()
        # split() also cuts at the four separator controls, which the tokenizer keeps
        chunks = _CHUNK.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        out = list(map(known.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[i]
                    out[i] = ids = known.get(chunk) or self._chunk(chunk)
                    if len(known) <= self.remembered:
                        known[chunk] = ids
        return b"".join(out)


PIECES = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, path=None, with_ids=False, remembered=REMEMBERED):
    """Tokens of each document and an end mark, cut into full pieces and a rest.

    A null or empty text is the end mark alone.  With ``with_ids`` the ids
    themselves come along as ``ids`` (binary, little-endian unsigned 32 bit).
    ``remembered`` bounds the chunks that a task keeps encoded, a matter of memory and speed only.
    """
    path = path or tokenizer_path()
    schema = PIECES.format(docs.schema[id_col].dataType.simpleString()) + (", ids binary" if with_ids else "")

    def cut(batches):
        tokens = ChunkTokens(path, remembered)
        for batch in batches:
            names, which, rows, bodies = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + struct.pack("<I", END)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    body = ids[4 * start : 4 * (start + capacity)]
                    which.append(i)
                    rows.append((start, len(body) // 4, zlib.crc32(body), n))
                    if with_ids:
                        bodies.append(body)
                if len(rows) > 50_000 or sum(map(len, bodies)) > 32_000_000:
                    yield build(names, which, rows, bodies)
                    which, rows, bodies = [], [], []
            yield build(names, which, rows, bodies)

    def build(names, which, rows, bodies):
        columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        arrays = [names.take(pa.array(which, pa.int64()))] + [pa.array(np.ascontiguousarray(c)) for c in columns]
        labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array(bodies, pa.binary()))
            labels.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=labels)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def fullest(counts, room):
    """Lengths and how often each, taken from ``counts``, that fill ``room`` closest.

    ``counts`` maps length to how many are left.  Bit s of ``reach`` says that sum
    s can be made; lengths enter from the largest, each in powers of two up to what
    is left, and the search ends once the room is filled exactly.  Going back
    through the steps gives the count of each length.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k in counts if k <= room and counts[k] > 0), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def patterns(histogram, capacity=CAPACITY):
    """Fill sequences from ``{length: how many}``: a list of (times, {length: count in each}).

    The longest remaining piece opens a sequence, the fullest completion closes
    it, and the pattern repeats as often as the counts allow.  Work and result
    depend on the capacity, not on the number of pieces.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    plan = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        used = fullest(counts, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return plan


def slots(plan):
    """Rows (length, first rank, rank after the last, how many in a sequence, first sequence, offset of the first)."""
    rows, given, sequence = [], {}, 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n, rank = used[length], given.get(length, 0)
            rows.append((length, rank, rank + n * times, n, sequence, offset))
            given[length] = rank + n * times
            offset += n * length
        sequence += times
    return rows


def pack(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, path=None, with_ids=False, remembered=REMEMBERED):
    """Place every token piece of ``docs`` in a sequence of at most ``capacity`` ids.

    Output: the columns of :func:`pieces` and ``sequence_id``, ``offset`` (gapless
    from 0 within a sequence).  The lengths of the pieces, at most ``capacity``
    different ones, are counted and planned (:func:`patterns`); a piece then finds
    its place by its rank among the pieces of its length, a distributed running
    count, so a hot length is no single task.  The plan is broadcast: its size
    depends on the capacity alone.  Null texts and ids are documents like others,
    equal rows are packed as often as they come, an empty table gives no rows, and
    other columns of the input are not read.
    """
    cut = pieces(docs, id_col, text_col, capacity, path, with_ids, remembered).withColumn("_one", F.lit(1).cast("long"))
    # range partitioning reads its input twice: once for the cuts
    ranked = running_totals(reliable_checkpoint(cut), ["length"], ["doc_id", "start", "ids_crc32"], ["_one"])
    # at most one row per possible length
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    spark = docs.sparkSession
    names = "_length long, _from long, _to long, _n long, _sequence long, _offset long"
    plan = F.broadcast(spark.createDataFrame(slots(patterns(histogram, capacity)), names))
    at = F.col("before__one") - F.col("_from")
    turn = F.floor(at / F.col("_n")).cast("long")
    return ranked.join(
        plan, (F.col("length") == F.col("_length")) & (F.col("before__one") >= F.col("_from")) & (F.col("before__one") < F.col("_to"))
    ).select(
        *[c for c in cut.columns if c != "_one"],
        (F.col("_sequence") + turn).alias("sequence_id"),
        (F.col("_offset") + (at - turn * F.col("_n")) * F.col("length")).alias("offset"),
    )


def op6_packing(spark, folder):
    return pack(table(spark, folder, "documents"))
