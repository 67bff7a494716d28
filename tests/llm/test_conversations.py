import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoquarry.llm import chat, trie

CLASH = ["before", "seg", "kind", "cost", "tie", "number", "depth", "p1", "g1", "at", "rep", "n", "place", "h", "base"]
SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 40), *range(100, 140), 205, -3]:
        for k in range(rng.randint(1, 9)):
            role = "system" if k == 0 and c % 3 == 0 else ("user", "assistant")[k % 2]
            rows.append((c, k, role, rng.choice(["ok", "yes sure", "a b c d e f", "<|im_end|>\n<s>[INST]", "", None])))
    rows += [(50, None, "user", "first, without a turn"), (50, 0, None, "no role"), (50, 1, "assistant", None), (50, 1, "assistant", "same turn")]
    rows += [(51, 0, "user", "twice"), (51, 0, "user", "twice"), (None, 0, "user", "whose?"), (None, 1, "assistant", "nobody's"), (52, None, None, None)]
    # one conversation holds a large part of all rows; two others are alike
    rows += [(150, k, ("user", "assistant")[k % 2], f"word {k} " * (k % 11)) for k in range(300)]
    rows += [(151, 0, "assistant", "long " * 900), (151, 1, "us\ner\\n", "<\\|im_start|>"), (151, 2, "assistant", "\\n 漢字 🙂")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["junk"] * len(CLASH)) for r in odd_rows()], SCHEMA).repartition(5)


def in_order(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}


def brute_windows(turns, budget, history, segment):
    """(repeated turns, new turns) of each window by looking at every turn in turn."""
    cost = [len(t.split()) + chat.MARKS for _, t in turns]
    before = [sum(cost[:i]) for i in range(len(cost))]
    system = cost[0] if turns[0][0] == "system" else 0
    out, at = [], 0
    while at < len(turns):
        room = budget - (system if at else 0)
        back, limit = at, min(history, room - cost[at])
        while back > (1 if system else 0) and sum(cost[back - 1 : at]) <= limit:
            back -= 1
        end = at + 1
        while end < len(turns) and before[end] // segment == before[at] // segment and sum(cost[back : end + 1]) <= room:
            end += 1
        out.append(([0] if system and at else []) + list(range(back, at)))
        out[-1] = (out[-1], list(range(at, end)))
        at = end
    return out


@pytest.mark.parametrize("budget,history,segment", [(40, 12, 200), (40, 0, 40), (9, 9, 9), (512, 128, 32768)])
def test_windows_are_those_of_a_turn_by_turn_walk(odd, budget, history, segment):
    rows = chat.format_chats(odd, budget, history, segment).orderBy("place").collect()
    turns = in_order(odd_rows())
    got = defaultdict(list)
    for r in rows:
        got[r["conv_id"]].append(r)
    assert set(got) == set(turns)
    for c, mine in turns.items():
        want = brute_windows(mine, budget, history, segment)
        assert len(want) == len(got[c]), c
        for (repeated, new), r in zip(want, got[c]):
            assert chat.turns_in(r["formatted"]) == [mine[i] for i in repeated + new]
            assert (r["repeated"], r["turns"]) == (len(repeated), len(repeated + new))
            assert r["tokens"] == sum(len(mine[i][1].split()) + chat.MARKS for i in repeated + new)
            assert r["tokens"] <= budget or len(new) == 1
            masked = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
            assert masked == [mine[i][1] for i in new if mine[i][0] == "assistant"]


def test_read_back_gives_every_turn_once(odd):
    turns = in_order(odd_rows())
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(odd, 40, 12, 200)).collect()}
    for c, mine in turns.items():
        said = "".join(t for r, t in mine if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))


def test_escapes_are_undone():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["<", "|", "\\", "[INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "/", "s>", "im_end|>", "\n", "n", "é"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        assert chat.role_of(chat.header(text)) == text
        assert chat.turns_in(chat.turn_text(text, text) * 2) == [(text, text)] * 2
    assert chat.escape("plain < text [1]") == "plain < text [1]"


def test_a_given_token_count_is_used(odd):
    rows = chat.format_chats(odd, budget=6, history=0, segment=1000, tokens=F.lit(1)).where("conv_id = 150").collect()
    assert len(rows) == 300 and {r["tokens"] for r in rows} == {5}


def brute_trie(rows):
    own = {c: t for c, t in in_order(rows).items() if c is not None}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(set)
    for s in members:
        if s:
            children[s[:-1]].add(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return {
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], sha(",".join(map(str, sorted(c for c in m if whole[c] == s)))))
        for s, m in members.items()
    }


def test_trie_equals_every_prefix_listed(odd):
    got = [tuple(r) for r in trie.prefix_trie(odd).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    want = brute_trie(odd_rows())
    assert len(got) == len(want) and set(got) == want


def test_end_lists_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c * 100, 0, "user", "hello") for c in range(50)] + [(c, 0, "user", "hello") for c in range(1, 30)]
    got = {tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(*r, *[""] * len(CLASH)) for r in rows], SCHEMA)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}
    assert got == brute_trie(rows)


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_chats(empty)).count() == 0 and trie.prefix_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 0, "user", "x", *[""] * len(CLASH))], SCHEMA)
    assert trie.prefix_trie(nobody).count() == 0
