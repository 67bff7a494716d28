import collections
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geoquarry.llm import mixing, packing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_targets_on_awkward_rows(tables):
    got = mixing.mix(tables.odd).toPandas()
    assert len(got) == len(tables.rows)
    sizes = collections.Counter()
    for _, text, _, source in tables.rows:
        sizes[source] += words(text)
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # water filling by plain repetition
    target, free, left = {}, set(order), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target.update({s: level * weight[s] for s in free})
    for source, part in got.groupby(got["source"].fillna("?")):
        key = None if source == "?" else source
        assert (part["source_size"] == sizes[key]).all()
        assert np.allclose(part["target"], target[key])
        assert part["taken"].sum() == int(np.floor(part["target"].iloc[0] + 1e-9))
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mix_reruns_agree_and_empty(tables):
    keys = ["doc_id", "source", "text_hash", "taken"]
    first, second = (mixing.mix(tables.odd).select(*keys).toPandas().sort_values(keys).reset_index(drop=True) for _ in range(2))
    assert first.equals(second)
    assert mixing.mix(tables.empty).count() == 0
    assert mixing.mixed_documents(tables.empty).count() == 0


def test_mixed_documents_hold_the_words_that_were_planned(tables):
    plan = mixing.mix(tables.odd).toPandas()
    made = mixing.mixed_documents(tables.odd)
    assert made.columns == tables.odd.columns
    rows = made.toPandas()
    got, want = collections.Counter(), collections.Counter()
    for row in rows.itertuples():
        got[(str(row.doc_id), row.source)] += words(row.text)
    for row in plan.itertuples():
        want[(str(row.doc_id), row.source)] += row.taken
    assert +got == +want


def test_tokens_equal_the_tokenizers_own():
    tokens = packing.ChunkTokens(packing.tokenizer_path())
    alphabet = " \t\n\x0b\x0c\x1c\x85\xa0aBzéÉß́中🙂İΣς0²'s<|endoftext|>!.-×ÿŸºª\x00"

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=40))
    def check(text):
        want = tokens.encoder.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want

    check()
    for text in ("It's we'll 'S <|startoftext|>x", "A" * 3000, "don't!!'s"):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.encoder.encode(text, add_special_tokens=False).ids


def brute_fullest(counts, room):
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {s + length for s in reach if s + length <= room}
    return max(reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fullest_is_closest(counts, room):
    used = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == brute_fullest(counts, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 300), max_size=12))
def test_patterns_use_every_piece_once(histogram):
    used = collections.Counter()
    for times, pattern in packing.patterns(histogram, 32):
        assert sum(k * n for k, n in pattern.items()) <= 32
        for k, n in pattern.items():
            used[k] += n * times
    assert used == collections.Counter(histogram)


def test_pack_places_every_token_once(tables):
    for docs in (tables.odd, tables.empty):
        got = packing.pack(docs, with_ids=True).toPandas()
        if docs is tables.empty:
            assert len(got) == 0
            continue
        for _, sequence in got.sort_values("offset").groupby("sequence_id"):
            assert sequence["offset"].tolist() == [0, *sequence["length"].cumsum().tolist()[:-1]]
            assert sequence["length"].sum() <= 2048
        assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(got["ids"], got["ids_crc32"], got["length"]))
        tokens = packing.ChunkTokens(packing.tokenizer_path())
        want = sum(len(tokens.encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in tables.rows)
        assert got["length"].sum() == want
        big = got[got["doc_id"] == 5].sort_values("start")
        ids = np.frombuffer(b"".join(big["ids"]), "<u4").tolist()
        text = next(t for i, t, _, _ in tables.rows if i == 5)
        assert ids == tokens.encoder.encode(text, add_special_tokens=False).ids + [1]
        assert (big["doc_tokens"] == len(ids)).all()
        # little padding: at most one window short of the least
        assert got["sequence_id"].nunique() <= -(-want // 2048) + 1
