"""Language identification by rank-order profiles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoquarry.llm.common import fold_is, table

#: Longest n-gram in characters, n-grams kept of a profile, and sampled documents of each language.
LONGEST, KEPT, PER_LANGUAGE = 3, 400, 300
#: The fold that is never learned from.
HELD_OUT = (4, 2)
_PART = 1 << 18
_letters = None


def letters():
    """For each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)
    return _letters


def gram_counts(text):
    """Keys and counts of the 1- to 3-grams of a text's words, each word between blanks.

    Letters are lower-cased, and anything else is one blank.  A key packs the
    code points, 21 bits each.  Long texts are counted in parts.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(letters()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    for at in range(0, len(codes), _PART):
        part = codes[at : at + _PART + LONGEST - 1]
        keys = []
        for n in range(1, LONGEST + 1):
            stop = min(_PART, len(part) - n + 1)
            key = part[:stop]
            for i in range(1, n):
                key = (key << 21) | part[i : i + stop]
            # no gram spans two words
            inner = np.zeros(stop, bool)
            for i in range(1, n - 1):
                inner |= part[i : i + stop] == 32
            whole = ~inner if n > 1 else key != 32
            keys.append(key[whole])
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def ranking(keys, counts, kept=KEPT):
    """The most frequent grams, most frequent first, ties by key."""
    if len(keys) > 4 * kept:
        floor = np.partition(counts, len(counts) - kept)[len(counts) - kept]
        some = counts >= floor
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:kept]


def learn(sample, kept=KEPT):
    """Profiles from pandas columns ``text`` and ``lang``: (languages, sorted grams, rank of each gram by language)."""
    profiles = {}
    for lang, texts in sorted(sample.groupby("lang")["text"]):
        counted = [gram_counts(t) for t in texts]
        keys, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        ranks = ranking(keys, np.bincount(at, np.concatenate([c for _, c in counted]), len(keys)), kept)
        if len(ranks):
            profiles[lang] = ranks
    grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
    places = np.full((len(profiles), len(grams) + 1), kept, np.int64)
    for i, ranks in enumerate(profiles.values()):
        places[i, np.searchsorted(grams, ranks)] = np.arange(len(ranks))
    return list(profiles), grams, places


def distances(text, model, kept=KEPT):
    """Out-of-place distance of a text to each profile, from 0 to 1; None without letters."""
    languages, grams, places = model
    own = ranking(*gram_counts(text), kept)
    if not len(own) or not languages:
        return None
    at = np.searchsorted(grams, own)
    known = at < len(grams)
    known[known] = grams[at[known]] == own[known]
    at = np.where(known, at, len(grams))  # the last column is the penalty of a gram no profile has
    place = places[:, at]
    out = np.where(place == kept, kept, np.abs(place - np.arange(len(own))))
    return out.sum(1) / (kept * len(own))


def language_sample(docs, per_language=PER_LANGUAGE, id_col="doc_id", lang_col="lang"):
    """At most ``per_language`` ids of each non-null language outside the held-out fold, the first by hash of the id."""
    ids = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).where(
        F.col(lang_col).isNotNull() & ~fold_is(id_col, *HELD_OUT)
    )
    # a hash threshold leaves about twice as many as wanted, so that the ranking of a language is small
    counts = ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_lang", "_g")
    near = ids.withColumn("_h", F.xxhash64("_id")).join(F.broadcast(counts), F.col("_lang") == F.col("_g"))
    few = near.where(F.pmod("_h", F.lit(1 << 31)).cast("double") * F.col("_n") <= F.lit((2 * per_language + 100) * (1 << 31)).cast("double"))
    first = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = few.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_language)
    return chosen.select("_id", "_lang")


def sampled_texts(docs, per_language=PER_LANGUAGE, id_col="doc_id", text_col="text", lang_col="lang"):
    """The sample's texts on the driver: columns ``text`` and ``lang``.

    Broadcasts and result hold at most ``per_language`` rows for each language that ``lang`` names.
    """
    chosen = language_sample(docs, per_language, id_col, lang_col)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), (F.col("_doc") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
        .where(F.col("text").isNotNull()).toPandas()
    )
    return rows.sort_values(["_doc", "text"]).groupby("lang").head(per_language)[["text", "lang"]]


def identify(docs, model, id_col="doc_id", text_col="text"):
    """Nearest language of each whole text by out-of-place distance of its most frequent n-grams.

    Output: id, ``held_out``, ``lang_pred``, ``score`` (how much nearer the best
    profile is than the second, in parts of the second; 1 where there is only one), ``distance``.  Null texts and texts
    without a letter give ``und`` and 0; ties go to the first language by name;
    repeated rows agree; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            names, scores, far = [], [], []
            for text in batch.column(1):
                found = distances(text.as_py() or "", model)
                if found is None:
                    names.append("und"), scores.append(0.0), far.append(1.0)
                    continue
                best = int(found.argmin())
                rest = np.delete(found, best)
                second = rest.min() if len(rest) else 1.0
                names.append(model[0][best]), far.append(float(found[best]))
                scores.append(float((second - found[best]) / second) if second > 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.float64())],
                names=["doc_id", "lang_pred", "score", "distance"],
            )

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(nearest, f"doc_id {kind}, lang_pred string, score double, distance double")
    return found.select("doc_id", fold_is("doc_id", *HELD_OUT).alias("held_out"), "lang_pred", "score", "distance")


def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return identify(docs, learn(sampled_texts(docs))).select("doc_id", "held_out", "lang_pred", "score")
