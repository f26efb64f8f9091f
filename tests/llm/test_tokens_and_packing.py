"""op1 and op4: against the tokenizers library, one text at a time."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow.llm import packing, token_store
from quillflow.llm.mph import PerfectHash
from quillflow.llm.tokens import WordEncoder, default_vocabulary, with_end

from .conftest import ROWS


@pytest.fixture(scope="module")
def lib():
    return WordEncoder(default_vocabulary())


def plain(lib, text):
    return lib.lib.encode(text or "", add_special_tokens=False).ids


#: Letters whose lower case or composition is more pieces or fewer, and control characters that only some take for white space.
_ODD = "İक़ख़ﬁẞǅΩK\u0301\u0308\x00\x1c\x1d\x1e\x1f\x85\xa0\u2028\ufeff\u200d𝐀𐐀"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aB'’.,!?é İΣ\t\n<|endoftxsar>0١", max_size=60), st.text(alphabet="ab' .!7" + _ODD, max_size=30)), max_size=6))
def test_words_at_a_time_equal_whole_texts(texts):
    lib = _lib()
    ids, off = lib.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == plain(lib, t)


def test_words_that_share_a_call_do_not_shift_each_other():
    texts = ["!\x1c! one", "plain words here", "a\x1cb two"]
    letters = [chr(c) for c in range(0x80, 0x110000) if chr(c).isalpha()]
    many = letters[:600] + list(_ODD)
    texts += [f"x {w} y{w}z {w}!" for w in many] + ["plain words here"]
    lib = WordEncoder(default_vocabulary())
    ids, off = lib.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == plain(lib, t)


def test_every_letter(lib):
    """Each letter between two others, thousands of words to a batch; the library has them one at a time."""
    letters = [chr(c) for c in range(0x80, 0x32000) if chr(c).isalpha()][::7]
    ids, off = WordEncoder(default_vocabulary()).encode(pa.array(letters))
    alone = [e.ids for e in lib.lib.encode_batch(letters, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == alone


_kept = []


def _lib():
    if not _kept:
        _kept.append(WordEncoder(default_vocabulary()))
    return _kept[0]


def test_memo_may_overflow(lib, monkeypatch):
    monkeypatch.setattr("quillflow.llm.tokens.MEMO_WORDS", 5)
    texts = [f"alpha{k} beta{k} gamma, delta" for k in range(20)]
    for t in texts:
        ids, _ = lib.encode(pa.array([t]))
        assert ids.tolist() == plain(lib, t)


def test_end_ids():
    ids, off = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 1)
    assert ids.tolist() == [5, 6, 1, 1, 7, 1] and off.tolist() == [0, 3, 4, 6]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    made, _ = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    others = np.arange(2**63, 2**63 + 20_000, dtype=np.uint64)
    assert (made.slots(others) >= 0).sum() <= 1


def by_order(rows):
    import xxhash

    tie = lambda t: -(2**63) if t is None else (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (h >> 63 << 64)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))


def test_store_round_trip(spark, odd, lib):
    store = token_store.write_store(odd, default_vocabulary(), end_id=2)
    got = sorted(token_store.read_back(store, odd, with_ids=True).collect(), key=lambda r: r["start"])
    start, expected = 0, []
    for doc_id, text, *_ in by_order(ROWS):
        ids = np.array([*plain(lib, text), 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert [x.tolist() for x in token_store.fetch(store, 9)] == [[*plain(lib, "one two"), 2]]
    assert len(token_store.fetch(store, 7)) == len(token_store.fetch(store, 6)) == 2 and token_store.fetch(store, 12345) == []
    assert token_store.look_up(store, spark.createDataFrame([(12345,), (None,)], "doc_id long")).count() == 0


def test_empty_store(empty):
    store = token_store.write_store(empty, default_vocabulary(), end_id=2)
    assert token_store.read_back(store, empty).count() == 0


def test_packing(odd, lib):
    rows = packing.pack(odd, capacity=64, with_ids=True).collect()
    texts = sorted(zlib.crc32(np.array([*plain(lib, t), 1], "<u4").tobytes()) for _, t, *_ in ROWS)
    by_doc = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 64 * r["piece"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = []
    for doc in by_doc.values():
        for first in [r for r in doc if r["piece"] == 0]:
            if len([r for r in doc if r["piece"] == 0]) == 1:
                whole.append(zlib.crc32(b"".join(bytes(r["ids"]) for r in sorted(doc, key=lambda r: r["piece"]))))
            else:
                whole.append(zlib.crc32(bytes(first["ids"])))
    assert sorted(whole) == texts
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_packing(empty):
    assert packing.pack(empty).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize(("n", "scale", "seed"), [(0, 1, 0), (1, 500, 1), (400, 700, 2), (400, 2500, 3), (3000, 1500, 4), (500, 5, 5)])
def test_plan_uses_few_sequences_and_places_all(n, scale, seed):
    lengths = np.minimum(4096, 1 + np.random.default_rng(seed).exponential(scale, n).astype(int))
    made = packing.plan(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)])), 4096)
    load = np.zeros(made.sequences, np.int64)
    for length, _, pieces, first, copies, _ in made.rows:
        load[first : first + pieces // copies] += length * copies
    assert load.sum() == lengths.sum() and (load <= 4096).all()
    assert made.sequences <= best_fit_decreasing(lengths, 4096)
    for length in np.unique(lengths):
        own = made.rows[made.rows[:, 0] == length]
        assert own[:, 1].tolist() == np.concatenate([[0], np.cumsum(own[:, 2])[:-1]]).tolist() and own[:, 2].sum() == (lengths == length).sum()


@pytest.mark.parametrize(("n", "scale", "seed"), [(3000, 400, 6), (3000, 1500, 4), (250_000, 500, 8), (250_000, 1500, 9)])
def test_most_tokens_come_from_the_program(n, scale, seed):
    lengths = np.minimum(4096, 1 + np.random.default_rng(seed).exponential(scale, n).astype(int))
    made = packing.plan(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)])), 4096)
    assert made.from_program >= 0.95 * lengths.sum()
    assert made.program <= max(np.ceil(made.bound), (1 + packing.GAP) * made.bound)
    assert made.sequences <= made.program + (lengths == 4096).sum()
    assert made.bound >= lengths[lengths < 4096].sum() / 4096 - 1e-3


def brute_sequences(lengths, capacity):
    """The fewest sequences, by trying every way."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j, r in enumerate(rooms):
            if r >= lengths[k] and r not in rooms[:j]:
                go(k + 1, [*rooms[:j], r - lengths[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_cover_against_every_way(lengths):
    made = packing.plan({x: lengths.count(x) for x in lengths}, 20)
    fewest, full = brute_sequences(sorted(lengths, reverse=True), 20), lengths.count(20)
    assert made.bound + full <= fewest + 1e-6 and fewest <= made.sequences <= fewest + 1


@pytest.mark.parametrize(
    ("name", "lengths", "most_gap"),
    [
        ("exponential", lambda r: np.clip(r.exponential(700, 250_000).astype(int) + 1, 1, 4096), 0.002),
        ("wide", lambda r: r.integers(1000, 3001, 100_000), 0.006),
        ("two fit", lambda r: r.integers(1366, 2048, 50_000), 0.0),
        ("one fits", lambda r: r.integers(2049, 4096, 20_000), 0.0),
        ("five near a third", lambda r: r.choice([1300, 1340, 1366, 1380, 1420], 50_000), 0.005),
        ("ten", lambda r: r.choice(r.integers(300, 2500, 10), 50_000), 0.005),
    ],
)
def test_the_program_is_solved_to_its_bound(name, lengths, most_gap):
    values, counts = np.unique(lengths(np.random.default_rng(1)), return_counts=True)
    made = packing.plan(dict(zip(values.tolist(), counts.tolist())), 4096)
    full = int(counts[values == 4096].sum())
    assert made.bound + full <= made.sequences + 1e-3 and made.sequences - full <= (1 + most_gap) * made.bound + 1
