"""Personal data: base patterns, and bootstrapped contextual extraction."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.llm.common import table, under_own_names
from geoquarry.session import reliable_checkpoint

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; least distinct instances, least seeds and least score of a pattern; least score of an instance.
ROUNDS, SUPPORT, SEEDS, PATTERN_SCORE, INSTANCE_SCORE = 3, 5, 3, 0.5, 0.5
#: Characters looked at on either side of an instance for its context words.
LEFT, RIGHT = 80, 40

#: Digits of an instance whose form is a pattern.
FORM_DIGITS = 9

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# whole digit runs: a match that fails from the start of a run fails from anywhere in it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = " \t\r\n\"'`.,;:!?()[]{}<>*#$%&|="


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text):
    """Spans of addresses: the run of local characters before an @, and the domain after it.

    A match can only begin where the run begins, so each @ is looked at once and
    texts full of them stay linear.
    """
    out, free, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        if at >= free:
            run = text[max(free, seen) : at]
            start = max(free, seen) + len(run.rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append((start, domain.end()))
                free = domain.end()
        seen = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text):
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _context(text, start, end):
    """Lexical patterns around a span: the two words before it, and the word on either side; None without a word before."""
    left = [w for w in (x.strip(_EDGE).lower() for x in text[max(0, start - LEFT) : start].split()[-3:]) if w][-2:]
    right = [w for w in (x.strip(_EDGE).lower() for x in text[end : end + RIGHT].split()[:2]) if w][:1]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    # masked: a digit in the context is any digit
    return [_DIGIT.sub("0", p) for p in out]


def _form(instance):
    """The lexical pattern of an instance itself: digits and runs of letters are alike; None for short numbers and plain words."""
    if "@" not in instance and len(_NOT_DIGIT.sub("", instance)) < FORM_DIGITS:
        return []
    return ["=" + _LETTERS.sub("a", _DIGIT.sub("0", instance.lower()))]


def mentions(text, base):
    """(start, end, kind or '', instance, patterns) of the base spans and of other chunks with a digit or an @.

    Patterns are the contexts of an instance and its own form, so an identifier
    that a base pattern passes over, such as one of two that stand side by side, can be known by its form.
    """
    out, taken = [], sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        out.append((a, b, kind, text[a:b].lower(), _context(text, a, b) + _form(text[a:b])))
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        # overlaps by an earlier, longer span are looked for a little way back
        if end - start < 4 or any(a < end and b > start for a, b in taken[max(0, at - 4) : at + 4]):
            continue
        patterns = _context(text, start, end) + _form(text[start:end])
        if patterns:
            out.append((start, end, "", text[start:end].lower(), patterns))
    return out


_MENTION = "array<struct<start:int,stop:int,kind:string,instance:string,patterns:array<string>>>"


def scan(docs, id_col="doc_id", text_col="text"):
    """Base results and mentions of each whole text, in one pass; ``body`` is a hash of the text."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, body long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, base_sha256 string, mentions {_MENTION}"
    names = ["doc_id", "body", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "mentions"]
    mention = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    keys = ("start", "stop", "kind", "instance", "patterns")

    def find(batches):
        for batch in batches:
            counts, joined, hashes, found = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                joined.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                hashes.append(hashlib.sha256(joined[-1].encode()).hexdigest())
                found.append([dict(zip(keys, x)) for x in mentions(text, spans)])
            columns = list(zip(*counts)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in columns], pa.array(joined, pa.string()), pa.array(hashes, pa.string()), pa.array(found, mention)],
                names=names,
            )

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(find, schema)


def discovered(scanned, rounds=ROUNDS):
    """Spans that high-confidence patterns find beside the base ones: ``doc_id``, ``body``, ``start``, ``stop``, ``kind``.

    The graph of patterns and instances is scored in turns: a pattern by the
    mean score of its distinct instances (seeds, the base finds, score 1; one
    imagined stranger damps rare patterns), an instance by the chance that not all
    its patterns are wrong.  Patterns with enough instances, seeds and score stand.
    """
    each = scanned.select("doc_id", "body", F.explode("mentions").alias("m")).select(
        "doc_id", "body", "m.start", "m.stop", "m.kind", "m.instance", F.explode("m.patterns").alias("pattern")
    )
    pairs = reliable_checkpoint(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    # a pattern that no seed has, or only one instance, never stands
    useful = pairs.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") != "").cast("int")).alias("seeds"),
        *[F.sum((F.col("kind") == k).cast("int")).alias(f"s_{k}") for k in KINDS],
    ).where((F.col("n") >= SUPPORT) & (F.col("seeds") >= SEEDS))
    most = F.greatest(*[F.col(f"s_{k}") for k in KINDS])
    kind = F.coalesce(*[F.when(F.col(f"s_{k}") == most, F.lit(k)) for k in KINDS])
    useful = useful.select(F.col("pattern").alias("p"), kind.alias("of"))
    known = reliable_checkpoint(pairs.join(useful, F.col("pattern") == F.col("p")).select("pattern", "instance", "of", (F.col("kind") != "").alias("seed")))
    instance = known.select("instance", F.col("seed").cast("double").alias("s")).distinct()
    for turn in range(rounds):
        values = instance.groupBy("instance").agg(F.max("s").alias("s")).withColumnRenamed("instance", "i")
        pattern = known.join(values, F.col("instance") == F.col("i")).groupBy("pattern").agg(
            (F.sum("s") / (F.count(F.lit(1)) + 1)).alias("c")
        ).withColumnRenamed("pattern", "p")
        instance = known.join(pattern, F.col("pattern") == F.col("p")).groupBy("instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.999)))))).alias("s")
        )
    good = pattern.where(F.col("c") >= PATTERN_SCORE).join(useful.withColumnRenamed("p", "q"), F.col("p") == F.col("q")).select("p", "of", "c")
    sure = instance.where(F.col("s") >= INSTANCE_SCORE).select(F.col("instance").alias("i"))
    new = each.where(F.col("kind") == "")
    return (
        new.join(good, F.col("pattern") == F.col("p")).join(sure, F.col("instance") == F.col("i"), "left_semi")
        .groupBy("doc_id", "body", "start", "stop").agg(F.max_by("of", F.struct("c", "of")).alias("kind"))
    )


def _grouped(found):
    """Per row identity, the discovered spans in order, as ``spans`` (array of kind, start, stop)."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("place")
    return found.groupBy(F.col("doc_id").alias("_d"), F.col("body").alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct(place, "start", "stop", "kind"))).alias("spans")
    )


def extract(docs, id_col="doc_id", text_col="text"):
    """Personal data of each whole text.

    Output: id, ``n_<kind>`` of the base kinds, ``base_sha256``, ``spans``: all
    spans as ``kind:start:end`` in code points, the base ones first, then the
    discovered ones as ``like_<kind>``.  A null or empty text has none; rows of
    one id are told apart by their text and equal rows share a result; an empty
    table gives no rows; other columns are not read.
    """
    scanned = reliable_checkpoint(scan(docs, id_col, text_col))
    more = _grouped(discovered(scanned))
    text = F.array_join(F.transform("spans", lambda s: F.concat(F.lit("like_"), s["kind"], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")
    return scanned.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b")), "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text).alias("spans")
    )


def redact(docs, id_col="doc_id", text_col="text"):
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; texts of any length are read whole; equal rows come out equal; an empty table gives no
    rows; other columns, of any name, are passed on.
    """
    return under_own_names(docs, [id_col, text_col], _redacted)


def _redacted(docs, id_col, text_col):
    found = _grouped(discovered(reliable_checkpoint(scan(docs, id_col, text_col))))
    names, place = docs.columns, docs.columns.index(text_col)
    keyed = docs.withColumn("_h", F.xxhash64(text_col))
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_b")), "left")
    more = joined.select(*names, F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), F.concat(F.lit("like_"), s["kind"]).alias("k"))).alias("_more"))

    def clean(batches):
        for batch in batches:
            texts = []
            for value, extra in zip(batch.column(place), batch.column(len(names))):
                text = value.as_py()
                if text is None:
                    texts.append(None)
                    continue
                spans = [(a, b, k) for k, a, b in base_spans(text)] + [(x["a"], x["b"], x["k"]) for x in extra.as_py() or []]
                out, at = [], 0
                for a, b, k in sorted(spans):
                    if a >= at:
                        out += [text[at:a], f"[{k}]"]
                    at = max(at, b)
                texts.append("".join(out) + text[at:])
            columns = [batch.column(i) if i != place else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return more.mapInArrow(clean, docs.schema)


def op9_pii(spark, folder):
    return extract(table(spark, folder, "documents"))
