"""Prefix trie of conversations by collapse of whole sequences.

Conversations of the same turns become one weighted sequence before anything is
expanded.  A prefix is named by the exclusive or of 64-bit hashes of (place,
role, text), twice with different seeds: such names add up along a conversation,
so a long one is named piece by piece in many tasks.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.llm.common import running_totals, table
from geoquarry.session import reliable_checkpoint

#: Ids up to the next multiple of GROUP share their first turns, as many as the hash of the id modulo HEADS says.
GROUP, HEADS = 100, 6
#: Ids in one piece of an end list.
PIECE = 4096
#: A prefix: its depth and two hashes.
KEY = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """``conv_id``, ``number`` (from 1, by turn, null first), ``h1`` and ``h2`` (128 bits of role and text), ``size`` of each turn.

    Null roles and texts count as empty; rows of one turn follow by the MD5 of
    role and text; rows without a conversation id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    body = F.md5(F.concat(F.length(role).cast("string"), F.lit("\n"), role, F.lit("\n"), text))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), body.alias("body"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("tie"), F.length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one"),
    )
    halves = [F.conv(F.substring("body", at, 15), 16, 10).cast("long") for at in (1, 17)]
    return running_totals(turns, ["conv_id"], ["turn", "tie"], ["one"]).select(
        "conv_id", (F.col("before_one") + 1).alias("number"), halves[0].alias("h1"), halves[1].alias("h2"), "size"
    )


def rebuilt(turns):
    """Rebuilt conversations as rows (``conv_id``, ``depth``, ``g1``, ``g2``, ``size``), and the table of all ids.

    Conversation c begins with the first crc32(c) % HEADS turns of c - c % GROUP, all
    if that has fewer, and goes on with its own turns after as many.
    """
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    ids = turns.groupBy("conv_id").agg(F.max("number").alias("n")).select("conv_id", "n", base.alias("base"), shared.alias("h"))
    heads = turns.where((F.col("number") < HEADS) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), "number", "h1", "h2", "size")
    lengths = ids.where(F.col("conv_id") == F.col("base")).select("base", F.least("n", F.lit(HEADS)).alias("has"))
    # a base has at most HEADS - 1 rows here, and fewer than 2 * GROUP conversations
    first = ids.join(heads, "base").where(F.col("number") <= F.col("h")).select("conv_id", F.col("number").alias("depth"), "h1", "h2", "size")
    own = turns.withColumns({"base": base, "h": shared}).where(F.col("number") > F.col("h"))
    rest = own.join(lengths, "base", "left").select(
        "conv_id", (F.col("number") - F.col("h") + F.least("h", F.coalesce("has", F.lit(0)))).alias("depth"), "h1", "h2", "size"
    )
    rows = first.union(rest)
    return rows.select("conv_id", "depth", F.xxhash64(F.lit("a"), "depth", "h1", "h2").alias("g1"), F.xxhash64(F.lit("b"), "depth", "h1", "h2").alias("g2"), "size"), ids.select("conv_id")


def sequences(rows, ids):
    """Identical rebuilt conversations as one: each id with the name of its whole sequence, and per sequence its weight ``n`` and smallest id ``rep``."""
    whole = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("g1").alias("p1"), F.bit_xor("g2").alias("p2"))
    zero = F.lit(0).cast("long")
    named = reliable_checkpoint(ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in KEY]))
    return named, reliable_checkpoint(named.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep")))


def prefixes(rows, chosen):
    """Each prefix of the chosen sequences (``rep``, ``n``): ``rep``, ``n``, KEY, the parent's ``b1`` and ``b2``, ``size``.

    Running exclusive ors over a range partitioning, shifted by those of the
    partitions before, so that one long sequence spans many tasks.
    """
    own = rows.join(chosen.select(F.col("rep").alias("conv_id"), "n"), "conv_id")
    placed = reliable_checkpoint(own.repartitionByRange("conv_id", "depth").withColumn("at", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "at").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    part = placed.groupBy("conv_id", "at").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    shift = part.select(
        F.col("conv_id").alias("c"), F.col("at").alias("part"), *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), zero).alias(f"o{i}") for i in (1, 2)]
    )
    local = placed.select("*", *[F.coalesce(F.bit_xor(f"g{i}").over(inside), zero).alias(f"l{i}") for i in (1, 2)])
    both = local.join(shift, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("part")))
    before = [F.col(f"l{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)]
    return both.select(
        F.col("conv_id").alias("rep"), "n", "depth", before[0].bitwiseXOR(F.col("g1")).alias("p1"), before[1].bitwiseXOR(F.col("g2")).alias("p2"),
        before[0].alias("b1"), before[1].alias("b2"), "size",
    )


def _batch(rows, last):
    """Rows of whole numbers and a text as an Arrow batch."""
    names = [*KEY, last] if last == "ends_sha256" else [*KEY, "first", last]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    types = [pa.int64()] * (len(names) - 1) + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def end_lists(named):
    """``ends_sha256`` of each sequence: SHA-256 of its ids, ascending, joined by commas.

    Ids are range-partitioned and written as pieces of text of up to PIECE ids; a
    sequence of very many conversations is hashed piece by piece as they arrive,
    and no list of it is held.
    """
    placed = named.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def pieces(batches):
        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for *now, conv in zip(*columns):
                if now != key or len(held) == PIECE:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held = now, []
                held.append(conv)
            yield _batch(out, "ids")
        if held:
            yield _batch([(*key, held[0], ",".join(map(str, held)))], "ids")

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if now != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _batch(out, "ends_sha256")
        if key:
            yield _batch([(*key, state.hexdigest())], "ends_sha256")

    names = "depth long, p1 long, p2 long"
    parts = placed.select(*KEY, "conv_id").mapInArrow(pieces, f"{names}, first long, ids string")
    return parts.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{names}, ends_sha256 string")


def subtrees(paths, nodes, inner):
    """KEY, ``n_leaves`` and ``saved_tokens`` of each node but the root.

    Sequences that are proper prefixes of others go; what stays are the leaves.
    Each node belongs to the smallest leaf below it, so the saving of a subtree is
    the sum, over the leaves through its top, of what their own nodes save from
    there on.
    """
    ends = paths.groupBy("rep").agg(F.max("depth").alias("depth"))
    last = paths.join(ends, ["rep", "depth"]).select("rep", *KEY)
    leaves = last.join(inner, KEY, "left_anti").select("rep")
    below = paths.join(leaves, "rep", "left_semi").select("rep", *KEY)
    owner = below.groupBy(*KEY).agg(F.min("rep").alias("rep"))
    saving = owner.join(nodes.select(*KEY, "saved"), KEY)
    valued = below.join(saving, ["rep", *KEY], "left").select("rep", (-F.col("depth")).alias("up"), "p1", "p2", F.coalesce("saved", F.lit(0)).alias("saved"))
    totals = running_totals(valued, ["rep"], ["up"], ["saved"])
    return totals.select((-F.col("up")).alias("depth"), "p1", "p2", (F.col("before_saved") + F.col("saved")).alias("tail")).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_leaves"), F.sum("tail").alias("saved_tokens")
    )


def prefix_trie(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """The nodes of the trie of rebuilt conversations, a row for each distinct sequence of first turns, the root included.

    Output: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Null roles and texts are empty; rows without a conversation id take no part;
    repeated rows are turns of their own; texts of any length are hashed whole and
    not moved; an empty table gives no rows; other columns are not read.
    """
    turns = reliable_checkpoint(numbered_turns(conversations, id_col, turn_col, role_col, text_col))
    rows, ids = rebuilt(turns)
    rows = reliable_checkpoint(rows)
    named, collapsed = sequences(rows, ids)
    paths = reliable_checkpoint(prefixes(rows, collapsed))
    nodes = reliable_checkpoint(
        paths.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.min("b1").alias("b1"), F.min("b2").alias("b2"), F.max("size").alias("size"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    )
    # per parent, the root (0, 0, 0) among them
    inner = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("p1"), F.col("b2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = collapsed.agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id")).where("conv_id is not null")
    zero = F.lit(0).cast("long")
    below = subtrees(paths, nodes, inner.select(*KEY))
    top = whole.crossJoin(nodes.agg(F.coalesce(F.sum("saved"), zero).alias("saved_tokens")))
    leaves = collapsed.join(inner.select(*KEY), KEY, "left_anti").agg(F.count(F.lit(1)).alias("n_leaves"))
    root = top.crossJoin(leaves).select(
        "conv_id", *[zero.alias(c) for c in KEY], F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens"
    )
    every = nodes.select("conv_id", *KEY).union(whole.select("conv_id", zero, zero, zero))
    parents = every.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    others = nodes.join(parents, ["depth", "b1", "b2"]).join(below, KEY).select(
        "conv_id", *KEY, "parent_conv_id", "n_convs", "n_leaves", "saved_tokens"
    )
    full = root.union(others).join(inner, KEY, "left").join(end_lists(named), KEY, "left")
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op13_trie(spark, folder):
    return prefix_trie(table(spark, folder, "conversations"))


SQL = """
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), lookup),
parts AS (SELECT i.conv_id, 0 AS part, o.k, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.k <= i.h
  UNION ALL SELECT i.conv_id, 1, o.k, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.k > i.h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, md5(length(role) || chr(10) || role || chr(10) || text) AS m
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
paths AS (SELECT conv_id, depth, size, string_agg(m, '') OVER w AS p FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
ends AS (SELECT conv_id, coalesce(max(depth), 0) AS depth FROM paths GROUP BY 1),
nodes AS (SELECT paths.depth, p, min(paths.conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
  string_agg(paths.conv_id::VARCHAR, ',' ORDER BY paths.conv_id) FILTER (ends.depth = paths.depth) AS e
  FROM paths JOIN ends USING (conv_id) GROUP BY paths.depth, p),
children AS (SELECT depth - 1 AS depth, p[:-33] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (SELECT a.depth, a.p, count(*) FILTER (c.n IS NULL) AS leaves, sum(CASE WHEN b.depth > 0 THEN (b.n - 1) * b.size ELSE 0 END) AS saved
  FROM (SELECT DISTINCT a.depth, a.p, b.depth AS bd, b.p AS bp FROM nodes b JOIN nodes a ON b.depth >= a.depth AND b.p[:32 * a.depth] = a.p) x
  JOIN nodes a ON a.p = x.p JOIN nodes b ON b.p = x.bp LEFT JOIN children c ON c.p = b.p GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
FROM nodes n JOIN below b USING (p) LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[:32 * (n.depth - 1)]
"""
