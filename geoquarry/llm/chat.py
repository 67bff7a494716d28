"""Chat formatting in budgeted windows of whole turns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoquarry.llm.common import WORD, running_totals, table

#: Tokens of a window; of the turns it repeats; that the marks of a turn cost.
BUDGET, HISTORY, MARKS = 512, 128, 4
#: A conversation is cut after about so many tokens, so that no task needs all of a long one.
SEGMENT = 64 * BUDGET
#: The template.  Between a turn's marks no control string is left, so the marks can be found again.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings, written as their first character and the rest; one more backslash between them escapes them.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_TURN = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text):
    """``text`` without control strings; a string that is already escaped gets a further backslash, so all can be undone."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text):
    return _ESCAPED.sub(r"\1\2\3", text)


def header(role):
    """A role as it stands in the opening mark: one line, no control string."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line):
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(line))


def turn_text(role, text):
    return f"{OPEN}{header(role)}\n{escape(text)}{CLOSE}"


def windows_of(cost, before, start, system, budget=BUDGET, history=HISTORY):
    """Windows of consecutive turns: (first repeated turn, first new turn, end).

    ``cost`` and ``before`` (the prefix sums) are of turns in order, new ones from
    ``start`` on; ``system`` is the cost of the retained turn, or 0.  A window repeats as many of the turns
    before it as fit into ``history`` and leave room for its first new turn,
    then takes new turns up to the budget, at least one.
    """
    ends, at, out = before + cost, start, []
    while at < len(cost):
        room = budget - (system if before[at] else 0)
        least = before[at] - max(0, min(history, room - cost[at]))
        # the retained turn is no part of the history
        back = min(at, max(int(np.searchsorted(before, least)), 1 if system and not before[0] else 0))
        end = max(at + 1, int(np.searchsorted(ends, before[back] + room, side="right")))
        out.append((back, at, end))
        at = end
    return out


def prepared(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", tokens=None):
    """Turns with their cost in tokens, and ``tie``, which orders rows of one turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    count = tokens if tokens is not None else F.regexp_count(text, F.lit(WORD))
    return conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("tie"), (F.coalesce(count, F.lit(0)) + MARKS).cast("long").alias("cost"),
    )


def format_chats(
    conversations, budget=BUDGET, history=HISTORY, segment=SEGMENT, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", tokens=None
):
    """Conversations as windows of formatted text with a loss mask.

    Output: ``conv_id``, ``place`` (tokens before the window's first new turn; orders
    the windows), ``formatted``, ``loss`` (array of (start, end), code points:
    the new assistant texts), ``repeated`` (how many leading turns stand in an
    earlier window), ``turns`` (how many in all), ``tokens``.

    Turns are whole.  A window holds the system turn (the first turn, if its role
    is ``system``), limited history, which is repeated without loss, and new
    turns; its tokens stay within ``budget`` unless the system turn and one new turn
    alone exceed it.  ``tokens`` is a column that counts the tokens of a turn's
    text; if none is given, words count.  A conversation is cut into segments at about
    every ``segment`` tokens; windows start anew there, with the history before,
    so a task holds a segment at most.

    Turns follow by number (null first), then by the MD5 of role and text; null
    roles and texts are empty; rows of a null conversation id form one
    conversation; repeated rows are turns of their own; a turn longer than the
    budget is a window by itself; an empty table gives no rows; other columns are not read.
    """
    if history > segment:
        raise ValueError("the history must fit into a segment")
    turns = prepared(conversations, id_col, turn_col, role_col, text_col, tokens)
    names = ["conv_id", "seg", "before", "kind", "cost", "role", "text"]
    order = ["turn", "tie"]
    # costs alone show which conversations are longer than a segment; only their turns are summed up in many tasks
    long = turns.groupBy("conv_id").agg(F.sum("cost").alias("whole")).where(F.col("whole") > segment).select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    zero = F.lit(0).cast("long")
    short = turns.join(long, same, "left_anti").select("conv_id", zero.alias("seg"), zero.alias("before"), F.lit(2).alias("kind"), "cost", "role", "text", *order)
    placed = running_totals(turns.join(long, same, "left_semi"), ["conv_id"], order, ["cost"])
    seg = F.floor(F.col("before_cost") / segment)
    own = placed.select("conv_id", seg.alias("seg"), F.col("before_cost").alias("before"), F.lit(2).alias("kind"), "cost", "role", "text", *order)
    # turns that the next segment may repeat, and the system turn for every later segment
    late = own.where((F.col("cost") <= history) & (F.col("before") >= (F.col("seg") + 1) * segment - history)).select(
        "conv_id", (F.col("seg") + 1).alias("seg"), "before", F.lit(1).alias("kind"), "cost", "role", "text", *order
    )
    first = own.where((F.col("before") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("c"), "cost", "role", "text", *order)
    later = own.where("seg > 0").select("conv_id", "seg").distinct()
    system = later.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "seg", zero.alias("before"), F.lit(0).alias("kind"), "cost", "role", "text", *order)
    kind = conversations.schema[id_col].dataType.simpleString()
    parts = short.union(own).union(late).union(system)

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(names))]):
                if row[:2] != key:
                    out += _segment(key, held, budget, history) if held else []
                    key, held = row[:2], []
                held.append(row[2:])
            yield _batch(out, batch.schema.field(0).type)
        if held:
            yield _batch(_segment(key, held, budget, history), batch.schema.field(0).type)

    ordered = parts.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "kind", "before", *order).select(*names)
    return ordered.mapInArrow(
        run, f"conv_id {kind}, place long, formatted string, loss array<struct<start:int,end:int>>, repeated int, turns int, tokens long"
    )


def _segment(key, rows, budget, history):
    """The windows of one segment; rows (before, kind, cost, role, text) with kind 0 the system turn, 1 history, 2 new."""
    if rows[-1][1] != 2:
        return []
    system = rows[0] if rows[0][1] == 0 or (rows[0][0] == 0 and rows[0][3] == "system") else None
    rows = [r for r in rows if r[1]]
    # the system turn is retained, so it is no history
    rows = [r for r in rows if r[1] == 2 or not (system and r[0] == 0)]
    cost, before = (np.array([r[i] for r in rows], np.int64) for i in (2, 0))
    start = next(i for i, r in enumerate(rows) if r[1] == 2)
    # new turns follow one another from where the segment begins
    before[start:] = before[start] + np.cumsum(cost[start:]) - cost[start:]
    texts = [turn_text(r[3], r[4]) for r in rows]
    out = []
    for back, at, end in windows_of(cost, before, start, system[2] if system else 0, budget, history):
        kept = [turn_text(*system[3:])] if system and before[at] else []
        whole, loss = kept + texts[back:at], []
        length = sum(map(len, whole))
        for (_, _, _, role, _), text in zip(rows[at:end], texts[at:end]):
            if role == "assistant":
                loss.append({"start": length + len(OPEN) + len(role) + 1, "end": length + len(text) - len(CLOSE)})
            whole.append(text)
            length += len(text)
        spent = int(cost[back:end].sum()) + (system[2] if kept else 0)
        out.append((key[0], int(before[at]), "".join(whole), loss, len(kept) + at - back, len(whole), spent))
    return out


def _batch(rows, kind):
    columns = list(zip(*rows)) if rows else [()] * 7
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [kind, pa.int64(), pa.string(), span, pa.int32(), pa.int32(), pa.int64()]
    names = ["conv_id", "place", "formatted", "loss", "repeated", "turns", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def turns_in(formatted):
    """(role, text) of each turn of a formatted window."""
    return [(role_of(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_back(windows):
    """Per conversation what its windows hold: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Repeated turns are passed over.  The windows of a conversation are hashed as they arrive in order; none
    are gathered, though a hash is made in one task by nature.
    """
    names = ["conv_id", "place", "formatted", "loss", "repeated"]
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        state, out = None, []
        for batch in batches:
            for conv, _, formatted, loss, repeated in zip(*[batch.column(i).to_pylist() for i in range(len(names))]):
                if state is None or conv != state.conv:
                    if state:
                        out.append(state.row())
                    state = _Digest(conv)
                state.add(formatted, loss, repeated)
            yield _digests(out, batch.schema.field(0).type)
            out = []
        if state:
            yield _digests([state.row()], batch.schema.field(0).type)

    return windows.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


class _Digest:
    """The running hashes of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted, loss, repeated):
        for role, text in turns_in(formatted)[repeated:]:
            self.text.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for span in loss:
            target = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
        self.chars += len(formatted)

    def row(self):
        return self.conv, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(rows, kind):
    columns = list(zip(*rows)) if rows else [()] * 6
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


#: The further conversation of the query; its texts are control strings of another template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark, folder):
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(given.unionByName(probe)))


SQL = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} AS cost, {len(OPEN) + 1 + len(CLOSE)}
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{CONTROL}', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g')) AS chars FROM given),
placed AS (SELECT *, row_number() OVER w AS k, sum(cost) OVER w AS upto FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text) ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, upto - cost AS before, (upto - cost) // {SEGMENT} AS seg, first_value(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER w AS s,
  first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER w AS s_chars FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
room AS (SELECT *, {BUDGET} - CASE WHEN k > 1 THEN s ELSE 0 END AS room FROM t),
back AS (SELECT a.conv_id, a.k, a.seg, any_value(a.room) AS room, any_value(CASE WHEN a.k > 1 THEN a.s_chars ELSE 0 END) AS kept,
  coalesce(sum(b.cost), 0) AS h, coalesce(sum(b.chars), 0) AS h_chars
  FROM room a LEFT JOIN t b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.k < a.k AND (b.k > 1 OR b.s = 0)
    AND a.before - b.before <= least({HISTORY}, a.room - a.cost) GROUP BY 1, 2, 3),
win AS (SELECT a.conv_id, a.k, a.seg, max(b.k) + 1 AS next, any_value(a.kept + a.h_chars) + sum(b.chars) AS chars
  FROM back a JOIN t c ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.k = a.k
  JOIN t b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.seg = a.seg AND b.k >= a.k AND (b.k = a.k OR b.upto - c.before <= a.room - a.h)
  GROUP BY 1, 2, 3),
used AS (SELECT w.* FROM win w JOIN (SELECT conv_id, seg, min(k) AS k FROM t GROUP BY 1, 2) f
    ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k
  UNION ALL SELECT w.* FROM used u JOIN win w ON w.conv_id IS NOT DISTINCT FROM u.conv_id AND w.seg = u.seg AND w.k = u.next),
size AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM used GROUP BY 1),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY 1)
SELECT whole.*, formatted_chars FROM whole JOIN size ON size.conv_id IS NOT DISTINCT FROM whole.conv_id
"""
