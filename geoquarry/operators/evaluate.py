"""Benchmark joins, text metrics and accuracies
(J1-J3, W8, F5-F9, A10-A12, A17, A18, L3, U5, U6)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.functions.text import brevity, contains_answer, score_answers, tokens
from geoquarry.operators.kernels import gram_stats, lcs_length
from geoquarry.operators.scale import join_facts

# Fixed values.
PLACEHOLDER = "PLACEHOLDER"
DEFAULT_SEED = 20260831
DEFAULT_TARGET = "the main object"
VOLATILE = ["date", "blocker", "reason", "normalisation", "checkpoint", "encoder", "input_bands", "basis", "metric", "stub_status"]
HASH_FACTOR, HASH_RANGE = 2654435761, 4294967296


def vqa_items(questions, answers, images):
    """Active questions with their answer and image, unmatched ones kept."""
    rows = questions.where(F.coalesce("active", F.lit(True))).join(answers, "qid", "left")
    return join_facts(rows, images, ["img_id"], "left")


def change_items(images, questions, answers):
    """Answered active questions grouped by file name (J2): (file_name, qid, ...).

    ``images`` has ``img_id, file_name, active`` and both dates' existence flags.
    """
    live = lambda df: df.where(F.coalesce("active", F.lit(True))).drop("active")
    known = live(answers).where(F.col("gold").isNotNull())
    asked = live(questions).join(known, "qid")
    both = live(images).where(F.col("has_t0") & F.col("has_t1")).select("img_id", "file_name")
    return join_facts(asked, both, ["img_id"])


def change_pairs(items, max_names=None):
    """Question count per file, first names in order."""
    pairs = items.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_questions"))
    return pairs if max_names is None else pairs.orderBy("file_name").limit(max_names)


def first_per_key(rows, keys, order):
    """First row of each key on a stable order (W8, J3, J4): one combinable minimum."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*keys, "_f.*")


def caption_items(captions, referring):
    """Captions with the first referring row of their image."""
    first = first_per_key(referring, ["image_id"], "ord").select("image_id", "target", "box")
    rows = join_facts(captions, first, ["image_id"], "left")
    return rows.withColumn("target", F.coalesce("target", F.lit(DEFAULT_TARGET)))


def with_caption(patches, annotations):
    """Patches that have a caption, with their first one."""
    notes = annotations.where("type = 'captioning'").select("key", "id", "output")
    return patches.join(first_per_key(notes, ["key"], "id").select("key", F.col("output").alias("caption")), "key")


#: Tokens that are counted at once, unless one pair has more; few enough for a core's cache.
_TOKENS = 1 << 15

STATS = "n_ref long, n_cand long, hits array<long>, clipped array<long>, total array<long>, dot long, rr long, cc long"


def _runs(batch):
    """The rows of a batch of (id, tokens, tokens) in runs of about ``_TOKENS`` tokens at most."""
    before = np.cumsum(sum(batch.column(i).value_lengths().to_numpy().astype(np.int64) for i in (1, 2)))
    start = 0
    while start < batch.num_rows:
        done = before[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(before, done + _TOKENS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def overlap(pairs, max_n=4, with_lcs=False):
    """N-gram overlap of each pair in one pass over whole texts, without a shuffle; ``lcs`` as well if asked for.

    Tokens are cut by Spark and arrive as arrays; the grams of many pairs are
    counted together as numbers, which spares exchanging every n-gram of
    the corpus.  A batch is counted in runs of pairs of bounded size, as a count takes
    many times the room of its tokens.  A null text has no tokens.
    """
    none = F.array().cast("array<string>")
    words = pairs.select("id", *[F.coalesce(tokens(F.col(c)), none).alias(c) for c in ("ref", "cand")])
    kind = dict(pairs.dtypes)["id"]

    def run(batches):
        for batch in (part for whole in batches for part in _runs(whole)):
            n = batch.num_rows
            sides = [batch.column(i) for i in (1, 2)]
            sizes = np.stack([s.value_lengths().to_numpy() for s in sides]).astype(np.int64)
            codes = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
            pair = np.concatenate([np.repeat(np.arange(n), k) for k in sizes])
            side = np.repeat([0, 1], sizes.sum(1))
            order = np.argsort(pair * 2 + side, kind="stable")
            pair, side, codes = pair[order], side[order], codes[order]
            *levels, products = gram_stats(pair, side, codes, n, max_n)
            ends = pa.array(np.arange(n + 1) * max_n, pa.int32())
            columns = [batch.column(0), *[pa.array(k) for k in sizes], *[pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in levels], *map(pa.array, products.T.copy())]
            names = ["id", "n_ref", "n_cand", "hits", "clipped", "total", "dot", "rr", "cc"]
            if with_lcs:
                cut = np.concatenate([[0], np.cumsum(sizes.T.ravel())])
                texts = [codes[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
                columns.append(pa.array([lcs_length(a, b) for a, b in zip(texts[::2], texts[1::2])], pa.int64()))
                names.append("lcs")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return words.mapInArrow(run, f"id {kind}, {STATS}" + (", lcs long" if with_lcs else ""))


def _share(counts):
    """Per level the counted share of the candidate's grams, 1 where it has none."""
    return F.zip_with(counts, "total", lambda h, t: F.when(t > 0, h / t).otherwise(1.0))


def bleu_score(max_n=4):
    """The reference's BLEU from overlap columns (F5): unclipped hits, mean of roots.

    A level without candidate n-grams counts as 1; a level without hits gives 0.
    """
    share = _share("hits")
    roots = F.aggregate(share, F.lit(0.0), lambda s, p: s + F.pow(p, F.lit(1.0 / max_n)))
    dead = (F.col("n_ref") == 0) | (F.col("n_cand") == 0) | F.exists(share, lambda p: p == 0)
    value = F.least(F.lit(1.0), brevity(F.col("n_cand"), F.col("n_ref")) * roots / max_n)
    return F.when(dead, 0.0).otherwise(value)


def clipped_score():
    """Textbook BLEU from overlap columns: clipped hits, geometric mean of the
    levels that have candidate grams (F5)."""
    levels = F.filter(F.arrays_zip("clipped", "total"), lambda p: p["total"] > 0)
    logs = F.aggregate(levels, F.lit(0.0), lambda s, p: s + F.log(p["clipped"] / p["total"]))
    dead = (F.col("n_ref") == 0) | (F.col("n_cand") == 0) | F.exists(levels, lambda p: p["clipped"] == 0)
    value = brevity(F.col("n_cand"), F.col("n_ref")) * F.exp(logs / F.size(levels))
    return F.when(dead, 0.0).otherwise(value)


def cosine_score():
    """Cosine of unigram frequencies from overlap columns."""
    length = F.sqrt(F.col("rr").cast("double")) * F.sqrt(F.col("cc").cast("double"))
    return F.coalesce(F.try_divide("dot", length), F.lit(0.0))


def bleu_ref(pairs, max_n=4):
    """BLEU as the reference computes it, per pair."""
    return overlap(pairs, max_n).select("id", bleu_score(max_n).alias("bleu"))


def bleu_clipped(pairs, max_n=4):
    """BLEU with clipped counts and a geometric mean, per pair."""
    return overlap(pairs, max_n).select("id", clipped_score().alias("bleu_clipped"))


def cider_proxy(pairs):
    """Cosine of unigram frequencies, per pair."""
    return overlap(pairs, 1).select("id", cosine_score().alias("cider_proxy"))


def lcs_lengths(pairs):
    """Longest common subsequence of the tokens of each pair."""
    return overlap(pairs, 1, with_lcs=True).select("id", "lcs")


def rouge_score():
    """F1 over the longest common subsequence from overlap columns."""
    p, q = F.try_divide("lcs", "n_cand"), F.try_divide("lcs", "n_ref")
    return F.coalesce(F.try_divide(2.0 * p * q, p + q), F.lit(0.0))


def rouge_l(pairs):
    """F1 over the longest common subsequence per pair."""
    return overlap(pairs, 1, with_lcs=True).select("id", rouge_score().alias("rouge_l"))


def caption_metrics(pairs, ious=None):
    """Corpus means of the text metrics, and of IoU over items with a box.

    Each text is cut into tokens once and all metrics come from one pass.
    """
    rows = overlap(pairs, with_lcs=True).select(bleu_score().alias("bleu"), rouge_score().alias("rouge_l"), cosine_score().alias("cider_proxy"))
    text = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("bleu", "rouge_l", "cider_proxy")],
    )
    if ious is None:
        return text
    # two one-row summaries side by side
    grounding = ious.agg(
        F.count("iou").alias("n_iou"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("grounding_iou")
    )
    return text.withColumn("_k", F.lit(1)).join(grounding.withColumn("_k", F.lit(1)), "_k").drop("_k")


def score_pairs(items):
    """F8 columns for each answered item."""
    return score_answers(items)


def vqa_metrics(items):
    """Accuracies per type and in total over routed, predicted rows (A10).

    ``items`` has ``type, routed_task, prediction, gold``.
    """
    rows = score_pairs(items)
    scored = (F.col("routed_task") == "vqa") & F.col("prediction").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(scored, c)), F.lit(0.0))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    wrong = F.sum(F.when(F.col("routed_task") == "vqa", 0).otherwise(1))
    total = F.count(F.lit(1))
    out = rows.rollup("type").agg(
        F.count(F.when(scored, 1)).alias("n_scored"), wrong.alias("n_misrouted"), total.alias("n_total"),
        ((total - wrong) / total).alias("routing_fidelity"),
        mean(flag("raw_match")).alias("raw_accuracy"), mean(flag("norm_match")).alias("normalised_accuracy"),
        mean(flag("answer_match")).alias("answer_match_rate"), mean(F.col("bleu1")).alias("bleu1"),
    )
    return out.withColumn("type", F.coalesce("type", F.lit("all")))


def change_qa_scores(items):
    """Containment score of each change answer."""
    return items.select("*", contains_answer(F.col("gold"), F.col("prediction")).alias("correct"))


def change_qa_metrics(items):
    """Accuracy per type and in total, with the majority answer and its share."""
    rows = change_qa_scores(items)
    per_type = rows.rollup("type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy")
    ).withColumn("type", F.coalesce("type", F.lit("all")))
    # the answer table shrinks to one row per (type, answer) before the winner is chosen
    golds = rows.groupBy("type", "gold").count()
    every = golds.unionByName(golds.groupBy("gold").agg(F.sum("count").alias("count")).withColumn("type", F.lit("all")))
    top = every.groupBy("type").agg(F.min(F.struct((-F.col("count")).alias("c"), "gold")).alias("m"))
    return per_type.join(top, "type").select(
        "type", "n", "accuracy", F.col("m.gold").alias("majority_answer"), (-F.col("m.c") / F.col("n")).alias("majority_share")
    )


def label_set_ceiling(patches):
    """How far label sets tell patches apart."""
    sets = patches.groupBy(F.array_join(F.array_sort("labels"), "|").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return sets.agg(
        total.alias("patches"), F.count(F.lit(1)).alias("distinct_sets"), F.max("n").alias("largest_set"),
        F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), total).alias("shared_share"),
        F.try_divide(F.count(F.lit(1)), total).alias("best_r1"),
    )


def prevalence_floor(patches):
    """Mean class prevalence and labels per patch."""
    n = patches.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_class = patches.select(F.explode("labels").alias("label")).groupBy("label").count()
    return per_class.agg(
        F.count(F.lit(1)).alias("classes"), F.avg(F.col("count") / n).alias("random_floor"),
        (F.sum("count") / F.max(n)).alias("labels_per_patch"),
    )


def sample_key(key, seed=DEFAULT_SEED):
    """A fixed pseudo-random number per row."""
    return (key * HASH_FACTOR + seed) % HASH_RANGE


def seeded_subset(rows, key, n, seed=DEFAULT_SEED):
    """The same ``n`` rows for the same seed; all rows when n <= 0."""
    if n <= 0:
        return rows
    return rows.orderBy(sample_key(F.col(key), seed), key).limit(n)


def prefix(rows, order, n):
    """First n rows in order (L4)."""
    return rows.orderBy(*order).limit(n)


def metric_rows(suite, metrics, date, n="n"):
    """A one-row metrics frame as long rows."""
    names = [c for c, t in metrics.dtypes if c != n and t in ("double", "bigint", "int")]
    entry = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    count = F.col(n).cast("long") if n in metrics.columns else F.lit(None).cast("long")
    return metrics.select(count.alias("n"), entry.alias("m")).select(
        F.lit(suite).alias("suite"), "m.metric", "m.value", "n", F.lit(date).alias("date"),
        F.when(F.col("m.value").isNull(), PLACEHOLDER).otherwise("measured").alias("status"),
    )


def placeholder(spark, suite, metric, blocker, date):
    """A metric that could not be measured, with the reason."""
    return spark.createDataFrame(
        [(suite, metric, None, None, date, PLACEHOLDER, blocker)],
        "suite string, metric string, value double, n long, date string, status string, blocker string",
    )


def union_metrics(*frames):
    """All suites in one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def repro_diff(first, second, keys=("suite", "metric"), drop=VOLATILE):
    """Rows that differ between two runs after dropping volatile fields."""
    keys = list(keys)
    keep = [c for c in first.columns if c in keys or c not in drop]
    values = [c for c in keep if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = side(first, "run1").join(side(second, "run2"), keys, "full_outer")
    return both.where(~F.col("run1").eqNullSafe(F.col("run2")))
