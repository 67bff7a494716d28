"""Examples and rules as tables of any size: an inverted index met in blocks, and a filter before patterns."""

import re
from re import _parser as patterns

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geoquarry.operators.routing import FLAGS, router_tokens
from geoquarry.session import reliable_checkpoint

#: Examples, and query texts, that meet in one task; blocks of examples, and of texts, where there are enough of them.
EXAMPLES, TEXTS = 65_536, 32_768
LEAST_BLOCKS = 4
#: Characters of a gram in the rule index.
GRAM = 3


def _postings(exemplars):
    """The rows of :func:`exemplar_index`.

    The joins are sorted ones by hint: unfolded words are many times what Spark
    takes them for from the size of their texts, and would be broadcast.
    """
    words = exemplars.select("example", "task", F.explode(router_tokens(F.col("text"))).alias("token")).groupBy("example", "task", "token").agg(
        F.count(F.lit(1)).alias("tf"))
    whole = exemplars.agg(F.count(F.lit(1)).alias("docs"))
    weights = words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(whole).select(
        "token", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("w"))
    weighted = words.join(weights.hint("merge"), "token")
    lengths = weighted.groupBy("example").agg(F.sqrt(F.sum(F.col("tf") * F.col("w") * F.col("w"))).alias("n"))
    return weighted.join(lengths.hint("merge"), "example").select("token", "example", "task", "tf", "w", "n")


def exemplar_index(exemplars):
    """Postings of an example table (``example, task, text``): (token, example, task, tf, w, n).

    ``w`` is the token's weight, its inverse document frequency over the table,
    and ``n`` the example's length, over which each occurrence of a word counts.
    Examples without a known word have no postings.
    """
    return reliable_checkpoint(_postings(exemplars))


def _query_words(queries, index):
    """Known words of each distinct query text with their counts, weights and the text's length."""
    words = queries.select("query").distinct().select("query", F.explode(router_tokens(F.col("query"))).alias("token")).groupBy("query", "token").agg(
        F.count(F.lit(1)).alias("tf"))
    known = words.join(index.select("token", "w").distinct().hint("merge"), "token")
    lengths = known.groupBy("query").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("w"), 2))).alias("n"))
    return reliable_checkpoint(known.join(lengths.hint("merge"), "query"))


def _blocks(rows, key, bound):
    """A one-row frame: how many blocks of about ``bound`` keys ``rows`` need, some for every core at least where there are enough keys."""
    n = F.count_distinct(key)
    return rows.agg(F.greatest(F.ceil(n / bound), F.least(F.lit(LEAST_BLOCKS), F.ceil(n / 1000)), F.lit(1)).cast("int").alias("blocks"))


def best_examples(queries, exemplars, tasks):
    """Best score of each query with the examples of each task (W7): (qid, task, score), 0 without a shared word.

    Each text is scored once.  Texts and examples are dealt into blocks of bounded
    size by hash, every pair of blocks meets in one task, and there the postings
    of a text's words are added up (:func:`_block_scorer`).  What leaves a task is one row for each
    text and task of the block, so neither candidates nor scores of single examples are exchanged.
    """
    tasks = list(tasks)
    index = exemplar_index(exemplars)
    words = _query_words(queries, index)
    right, left = _blocks(index, "example", EXAMPLES), _blocks(words, "query", TEXTS)
    own = lambda key: F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    every = lambda df, size, name: df.crossJoin(size).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # a text moves as one row, and its number of occurrences by weight and length is all a word of it needs
    bags = words.groupBy("query").agg(F.collect_list(F.struct("token", (F.col("tf") * F.col("w") * F.col("w") / F.col("n")).alias("x"))).alias("words"))
    asked = every(bags.crossJoin(left).withColumn("q_block", own("query")).drop("blocks"), right, "e_block")
    wanted = index.where(F.col("task").isin(tasks)).select("token", "example", "task", (F.col("tf") / F.col("n")).alias("y"))
    held = every(wanted.crossJoin(right).withColumn("e_block", own("example")).drop("blocks"), left, "q_block")
    keys = ["q_block", "e_block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_block_scorer, "query string, task string, score double")
    best = found.groupBy("query", "task").agg(F.max("score").alias("score")).groupBy("query").agg(
        F.map_from_entries(F.collect_list(F.struct("task", "score"))).alias("scores"))
    rows = queries.select("qid", "query").join(best, "query", "left").select("qid", "scores", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    return rows.select("qid", "task", F.coalesce(F.try_element_at("scores", F.col("task")), F.lit(0.0)).alias("score"))


def _block_scorer(texts, postings):
    """The best score of each text of a block with the examples of each task of another, where they share a word."""
    columns = ["query", "task", "score"]
    if texts.empty or postings.empty:
        return pd.DataFrame(columns=columns)
    example, token = (pd.factorize(postings[c])[0] for c in ("example", "token"))
    task, names = pd.factorize(postings["task"])
    # an example counts in each task that it is given for; those of a task lie side by side
    unit, at = np.unique(task * (example.max() + 1) + example, return_inverse=True)
    starts = np.searchsorted(unit, np.arange(len(names)) * (example.max() + 1))
    whole = unit % (example.max() + 1)
    split = len(np.unique(whole)) < len(whole)
    order = np.argsort(token, kind="stable")
    at, share = at[order], postings["y"].to_numpy()[order]
    cut = np.searchsorted(token[order], np.arange(token.max() + 2))
    where = {w: slice(a, b) for w, a, b in zip(pd.unique(postings["token"]), cut[:-1], cut[1:])}
    best = np.zeros((len(texts), len(names)))
    for row, words in zip(best, texts["words"]):
        known = [(where[w["token"]], w["x"]) for w in words if w["token"] in where]
        if not known:
            continue
        score = np.zeros(len(unit))
        for part, x in known:
            # a unit holds a token once
            score[at[part]] += x * share[part]
        if split:
            score = np.where(score > 0, np.bincount(whole, score)[whole], 0.0)
        row[:] = np.maximum.reduceat(score, starts)
    i, j = np.nonzero(best)
    return pd.DataFrame({"query": texts["query"].to_numpy()[i], "task": np.asarray(names)[j], "score": best[i, j]}, columns=columns)


def anchors(pattern):
    """Literals of which any text that the pattern matches holds at least one, in lower case; None if there is no such set."""
    sets = [s for s in _literal_sets(patterns.parse(pattern, re.IGNORECASE)) if min(map(len, s)) >= GRAM]
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _literal_sets(parsed):
    """Sets of literals, one of each of which every match holds."""
    out, run = [], ""
    for code, value in [*parsed, (None, None)]:
        if code is patterns.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            out.append({run})
            run = ""
        if code is patterns.SUBPATTERN:
            out += _literal_sets(value[-1])
        elif code in (patterns.MAX_REPEAT, patterns.MIN_REPEAT) and value[0] > 0:
            out += _literal_sets(value[2])
        elif code is patterns.BRANCH:
            branches = [max(_literal_sets(b), key=lambda s: min(map(len, s)), default=None) for b in value[1]]
            if all(branches):
                out.append(set().union(*branches))
    return out


def _plain(text):
    """Lower case, with the one further letter that a pattern takes for ``s`` regardless of case."""
    return F.translate(F.lower(text), "ſ", "s")


def rule_index(rules):
    """Grams that call a rule (``ordinal, task, name, pattern``): (gram, ordinal); null where the rule is tried on every text.

    For each literal of which a match needs one, its first gram calls the rule.
    """
    from pyspark.sql.types import ArrayType, StringType

    grams = F.udf(lambda p: sorted({a[:GRAM] for a in anchors(p) or ()}) or [None], ArrayType(StringType()))
    return rules.select("ordinal", F.explode(grams("pattern")).alias("gram"))


def rule_candidates(queries, rules):
    """Distinct query texts with the rules that they may match, by an equi join on grams: (query, ordinal)."""
    index = reliable_checkpoint(rule_index(rules))
    texts = queries.select("query").distinct()
    plain = _plain(F.col("query"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - GRAM + 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(GRAM)))
    called = texts.select("query", F.explode(F.array_distinct(grams)).alias("gram")).join(index, "gram").select("query", "ordinal").distinct()
    # rules without a needed literal are few; they meet every text once
    always = index.where("gram is null").agg(F.collect_set("ordinal").alias("every"))
    return called.unionByName(texts.crossJoin(always).select("query", F.explode("every").alias("ordinal")))


def rule_matches(queries, rules):
    """All rules of a table that each query matches (J16): (qid, ordinal, task, name); each text is tried once."""
    tried = rule_candidates(queries, rules).join(rules, "ordinal")
    # a pattern stays compiled while its rows last
    sorted_ = tried.repartition("ordinal", F.pmod(F.xxhash64("query"), F.lit(64))).sortWithinPartitions("ordinal")
    hits = sorted_.where(F.expr(f"regexp_like(query, concat('{FLAGS}', pattern))")).select("query", "ordinal", "task", "name")
    return queries.select("qid", "query").join(hits, "query").select("qid", "ordinal", "task", "name")


def tried_per_query(queries, rules):
    """How many patterns are tried on each query, of how many."""
    tried = rule_candidates(queries, rules).groupBy("query").agg(F.count(F.lit(1)).alias("tried"))
    whole = rules.agg(F.count(F.lit(1)).alias("rules"))
    return queries.select("qid", "query").join(tried, "query", "left").crossJoin(whole).select("qid", F.coalesce("tried", F.lit(0)).alias("tried"), "rules")
