"""Mixing sources to target weights."""

from pyspark.sql import functions as F

from geoquarry.llm.common import WORD, running_totals, table, under_own_names
from geoquarry.session import reliable_checkpoint

#: Weights by rank of the source, repeating; share of all words; most repeats of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes, weights=WEIGHTS, share=SHARE, epochs=EPOCHS):
    """Targets of sources: ``source``, ``size`` -> also ``target``.

    Sources by code point, null last, get the weights in turn and share ``share``
    times all words; none gets more than ``epochs`` times its size, and what that
    cuts off goes to the others by weight.  In order of size per weight the capped
    sources come first, so the level at which the rest is shared follows from
    running totals; no step needs all sources in one task.
    """
    ranked = running_totals(
        sizes.select("source", "size", F.col("source").isNull().alias("_last"), F.lit(1).cast("long").alias("_one")),
        [], ["_last", "source"], ["_one"],
    )
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("before__one") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "size", "_last", weight.alias("_w")).withColumn("_ratio", F.col("size") / F.col("_w"))
    level = running_totals(weighed, [], ["_ratio", "_last", "source"], ["size", "_w"])
    whole = level.agg(F.sum("size").alias("_all"), F.sum("_w").alias("_weights"))
    at = (F.lit(share) * F.col("_all") - epochs * F.col("before_size")) / (F.col("_weights") - F.col("before__w"))
    # the first source that its share does not fill sets the level
    first = level.join(F.broadcast(whole)).withColumn("_level", at).where(F.col("_level") <= epochs * F.col("_ratio")).agg(
        F.min_by("_level", F.struct("_ratio", "_last", "source")).alias("_level")
    )
    return level.join(F.broadcast(first)).select(
        "source", "size",
        F.when(F.col("_level") <= epochs * F.col("_ratio"), F.col("_level") * F.col("_w")).otherwise((epochs * F.col("size")).cast("double")).alias("target"),
    )


def mix(docs, id_col="doc_id", text_col="text", source_col="source", seed="mix", weights=WEIGHTS, share=SHARE, epochs=EPOCHS):
    """How many words of each document a weighted mix takes.

    Documents get a hash-random key (md5 of seed and id), are range-sorted by it
    within their source, and a source takes its target, rounded down, from that
    order, starting over when the source is used up; only the document at the cut
    is taken in part.  Output: ``doc_id``, ``source``, ``text_hash``, ``size`` (words), ``source_size``,
    ``target``, ``taken`` (words, repeats counted).

    A null text has no words; a null source is a source of its own; a null id
    hashes as the empty text.  Rows with one id are ordered by text, equal rows
    are interchangeable, an empty table gives no rows, and other columns of the
    input are not read.
    """
    small = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("_key"),
    )
    placed = running_totals(small, ["source"], ["_key", "doc_id", "text_hash"], ["size"])
    sizes = reliable_checkpoint(placed.groupBy("source").agg(F.sum("size").alias("size")))
    goals = source_targets(sizes, weights, share, epochs).select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), "target"
    )
    budget = F.floor("target").cast("long")
    size, whole = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    full = F.floor(budget / whole).cast("long")
    left = budget - full * F.col("source_size") - F.col("before_size")
    return placed.join(goals, placed["source"].eqNullSafe(goals["_source"])).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (full * size + F.greatest(F.lit(0), F.least(left, size))).cast("long").alias("taken"),
    )


def mixed_documents(docs, id_col="doc_id", text_col="text", source_col="source", **options):
    """The mix itself: a row of ``docs`` for each time it is used, in its own columns.

    A document used twice comes twice; at a source's cut the text is its first
    words, joined by one space.  A document of no words (also null) costs nothing and is used
    once.  Equal rows share one plan: the i-th of them takes the i-th amount.  Null
    sources are a source; an empty table gives no rows; other columns, of any name, are passed on.
    """
    return under_own_names(docs, [id_col, text_col, source_col], lambda *given: _mixed(*given, **options))


def _mixed(docs, id_col, text_col, source_col, **options):
    plan = mix(docs, id_col, text_col, source_col, **options)
    names = docs.columns
    takes = plan.groupBy(
        F.col("doc_id").alias("_m_id"), F.col("source").alias("_m_source"), F.col("text_hash").alias("_m_hash")
    ).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("_m_takes"), F.first("size").alias("_m_size"))
    own = docs.withColumn("_m_text", F.xxhash64(text_col)).join(
        takes,
        F.col(id_col).eqNullSafe(F.col("_m_id")) & F.col(source_col).eqNullSafe(F.col("_m_source")) & (F.col("_m_text") == F.col("_m_hash")),
    )
    # equal rows: hand out the amounts in turn; most keys have one row, and no window is needed for those
    single = own.where(F.size("_m_takes") == 1).withColumn("_m_take", F.element_at("_m_takes", 1))
    several = (
        own.where(F.size("_m_takes") > 1).groupBy(*names, "_m_size", "_m_takes").agg(F.count(F.lit(1)).alias("_m_n"))
        .select(*names, "_m_size", F.explode("_m_takes").alias("_m_take"))
    )
    parts = single.select(*names, "_m_size", "_m_take").unionByName(several)
    amount = F.when(F.col("_m_size") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m_take") + F.col("_m_size") - 1) / F.greatest("_m_size", F.lit(1))).cast("long")),
            lambda i: F.least(F.col("_m_size"), F.col("_m_take") - i * F.col("_m_size")),
        )
    )
    used = parts.withColumn("_m_words", F.explode(amount)).where((F.col("_m_words") > 0) | (F.col("_m_size") == 0))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_m_words").cast("int")), " ")
    cut = F.when(F.col("_m_words") < F.col("_m_size"), first_words).otherwise(F.col(text_col))
    return used.withColumn(text_col, cut).select(*names)


def op1_mixing(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM s),
v AS (SELECT *, size::DOUBLE / w AS ratio FROM r),
c AS (SELECT *, coalesce(sum(size) OVER before, 0) AS bs, coalesce(sum(w) OVER before, 0) AS bw FROM v
      WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(size) AS total, sum(w) AS weights FROM v),
l AS (SELECT c.*, (1.5::DOUBLE * total::DOUBLE - (2 * bs)::DOUBLE) / (weights - bw)::DOUBLE AS lv FROM c, t),
f AS (SELECT lv AS level FROM l WHERE lv <= 2 * ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, size AS source_size, CASE WHEN level <= 2 * ratio THEN level * w ELSE (2 * size)::DOUBLE END AS target FROM l, f),
p AS (SELECT d.*, source_size, target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (floor(target)::BIGINT // greatest(source_size, 1) * size
        + greatest(0, least(floor(target)::BIGINT % greatest(source_size, 1) - b, size)))::BIGINT AS taken
FROM p
"""
