"""Text columns: normalisation, tokens, n-grams and answer scores."""

from pyspark.sql import functions as F

#: Answer words that decide a question of each type (fixed values).
ANSWER_WORDS = {"presence": ["yes", "no"], "comp": ["yes", "no"], "rural_urban": ["rural", "urban"]}

#: Stands for a word boundary; no text of an answer holds it.
MARK = "\u0001"

#: Base of the brevity penalty (fixed value).
PENALTY_BASE = 2.718281828


def literal(value):
    """A text as a raw SQL literal, for long constant tables written as one expression."""
    mark = '"' if "'" in value else "'"
    if mark in value:
        raise ValueError("text holds both kinds of quotes")
    return f"r{mark}{value}{mark}"


def fixed(number, pattern):
    """A number as text with a fixed number of digits, such as ``0.00``."""
    return F.call_function("format_number", number, F.lit(pattern))


def strip(text):
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text):
    """Lower case, no outer space, single inner spaces (F1)."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def tokens(text):
    """Runs of ASCII letters and digits of the normalised text (F2); what normalising does to white space changes none."""
    return F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z]+)"), F.lit(1))


def ngrams(words, n):
    """All n-grams of a word array, joined by a space."""
    last = F.size(words) - n
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.array_join(F.slice(words, i + 1, n), " "),
    )
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def brevity(n_cand, n_ref):
    """1 when the candidate is strictly longer, else an exponential penalty."""
    power = F.pow(F.lit(PENALTY_BASE), 1 - n_ref / F.greatest(n_cand, F.lit(1)))
    return F.when(n_cand > n_ref, F.lit(1.0)).otherwise(power)


def bleu1(r, c):
    """Unigram overlap of two token columns with brevity penalty, for short answers."""
    hits = F.size(F.filter(c, lambda t: F.array_contains(r, t)))
    share = hits / F.size(c)
    score = F.least(F.lit(1.0), brevity(F.size(c), F.size(r)) * share)
    empty = (F.size(r) == 0) | (F.size(c) == 0)
    return F.when(empty | (hits == 0), F.lit(0.0)).otherwise(score)


def required_tokens(norm, words, kind):
    """Words a right answer must contain, from the normalised gold answer and its tokens."""
    closed = F.lit(False)
    for name, known in ANSWER_WORDS.items():
        closed = closed | ((kind == name) & norm.isin(known))
    return F.when(closed, F.array(norm)).otherwise(words)


def score_answers(rows):
    """Add raw, normalised and containment matches and BLEU-1 to answered rows (F8).

    ``rows`` has ``prediction, gold, type``.  Normal forms and tokens are columns
    of their own, so each text is read once.
    """
    ready = rows.withColumns({
        "_p": normalise(F.col("prediction")), "_g": normalise(F.col("gold")),
        "_pt": tokens(F.col("prediction")), "_gt": tokens(F.col("gold")),
    })
    ready = ready.withColumn("_need", required_tokens(F.col("_g"), F.col("_gt"), F.col("type")))
    have = F.col("_pt")
    return ready.withColumns({
        "raw_match": F.col("prediction") == F.col("gold"),
        "norm_match": F.col("_p") == F.col("_g"),
        "answer_match": (F.size("_need") > 0) & F.forall("_need", lambda t: F.array_contains(have, t)),
        "bleu1": bleu1(F.col("_gt"), have),
    }).drop("_p", "_g", "_pt", "_gt", "_need")


def contains_answer(gold, response):
    """The gold phrase occurs in the response on word boundaries."""
    word = F.lower(strip(gold))
    said = normalise(F.replace(response, F.lit("_"), F.lit(" ")))
    plain = F.when(word.isin("yes", "no"), word).otherwise(F.replace(word, F.lit("_"), F.lit(" ")))
    # a mark at each word boundary: the phrase stands there with a mark on either side
    marked = lambda t: F.regexp_replace(t, r"(?U)\b", MARK)
    phrase = F.concat(F.lit(MARK), F.call_function("btrim", marked(plain), F.lit(MARK)), F.lit(MARK))
    return F.when(plain == "", F.regexp_like(said, F.lit(r"(?U)\w"))).otherwise(F.contains(marked(said), phrase))


def text_confidence(text):
    """Confidence of a generated sentence from its length and refusals."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)))
    low = F.lower(text)
    refused = F.lit(False)
    for phrase in ("cannot see", "can't see", "unable", "i don't know"):
        refused = refused | low.contains(phrase)
    return (
        F.when(text.isNull() | (text == ""), 0.1)
        .when(refused, 0.3)
        .when(words < 2, 0.4)
        .when(words < 6, 0.65)
        .otherwise(0.85)
    )
