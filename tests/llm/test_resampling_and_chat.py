"""op11 against plain Python, op12 by its way back."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow.llm import chat_format as chat
from quillflow.llm import importance

from .conftest import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, longest, buckets, least, percent):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(code(f) for _, text in rows for f in plain_features(text, longest)[1])
    t = Counter(code(f) for text in target for f in plain_features(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets))))
    out = []
    for doc_id, text in rows:
        words, features = plain_features(text, longest)
        weight = sum(gain(code(f)) for f in features)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted((-1 if r[0] is None else r[0], *r[1:4], ranks.get(id(r), 0)) for r in out)


def found(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in rows.collect())


@pytest.mark.parametrize("longest, buckets, least, percent, piece", [(1, 10_000, 3, 40, 4 << 20), (2, 50, 1, 100, 200), (3, 1000, 3, 0, 1)])
def test_resampling_as_plain(odd, spark, monkeypatch, longest, buckets, least, percent, piece):
    monkeypatch.setattr(importance, "SLICE_BYTES", piece)
    target = ["the cat sat", None, "", "émile und die", "w7 w14"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resampled(odd, frame, longest, buckets, least, percent)
    assert found(got) == plain_resample([r[:2] for r in ROWS], target, longest, buckets, least, percent)


def test_many_equal_ids_and_scores_are_ranked_once_each(spark):
    rows = [(7, "one two three")] * 400 + [(k, "four five six") for k in range(200)]
    got = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("one",)], "text string"), least_words=1, percent=50)
    assert found(got) == plain_resample(rows, ["one"], 1, importance.BUCKETS, 1, 50)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 301))


def test_empty_tables(empty, odd, spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(empty, none).collect() == []
    assert found(importance.resampled(odd, none, least_words=1)) == plain_resample([r[:2] for r in ROWS], [], 1, importance.BUCKETS, 1, 10)


# ---- conversations


def plain_chat(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        size = sum(24 + len(r.replace("\\", "\\\\").replace("\n", "\\n")) + len(re.findall(r"<\\*\|", r)) + len(t) + len(re.findall(r"<\\*\|", t)) for r, t in turns)
        out.append((str(conv), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), size))
    return sorted(out)


def told(rows):
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in rows)


TURNS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", None),
    (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\n<\\|x"),
    (2, 5, "assistant", "first"),
    (2, None, "user", ""),
    (3, 0, "user", "a"),
    (3, 0, "user", "a"),
    (3, 1, "assistant", "é😀\x00"),
    (4, 0, None, "x"),
    (5, 0, "a\\n\n<|im_start|>", "y"),
    (6, 0, "system", ""),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "none"),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame([(*r, 3, "w", 0) for r in TURNS], "conv_id long, turn long, role string, text string, piece int, segments string, last int").repartition(3)


@pytest.mark.parametrize("piece", [8 << 20, 1])
def test_conversations_come_back(turns, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE_BYTES", piece)
    pieces = chat.formatted(turns)
    rows = chat.read_back(pieces).collect()
    assert told(rows) == plain_chat(TURNS)
    assert (max(r["piece"] for r in pieces.collect()) > 0) == (piece == 1)
    errors = {str(r["conv_id"]): r["error"] for r in rows}
    assert errors == {"1": None, "2": None, "3": "turn 1: user in state asked", "4": "turn 0: no role in state start", "5": "turn 0: a\\n\n<|im_start|> in state start", "6": "ends in state briefed", "None": None}


def test_loss_marks_each_learned_text_once(turns):
    for p in chat.formatted(turns).collect():
        text = "".join(s["text"] for s in p["segments"])
        assert len(chat.turns_of(text)) == p["n_turns"]
        assert [chat.unescaped(s["text"]) for s in p["segments"] if s["loss"]] == [t for r, t in chat.turns_of(text) if r == "assistant"]


def test_other_templates(spark):
    tools = chat.Template(turn_start="<|turn|>", turn_end="<|end|>", between="", learned=frozenset({"assistant", "tool"}), moves={"start": {"user": "asked"}, "asked": {"assistant": "said"}, "said": {"tool": "called", "user": "asked"}, "called": {"assistant": "said"}}, ends=frozenset({"said"}))
    rows = [(1, k, r, f"<|end|>{k}") for k, r in enumerate(("user", "assistant", "tool", "assistant"))] + [(2, 0, "user", "u")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), tools), tools).collect()}
    assert got[1]["loss_chars"] == 24 and got[1]["error"] is None and got[2]["error"] == "ends in state asked"
    with pytest.raises(ValueError):
        chat.Template(turn_start="[INST]")


def test_broken_output_is_an_error():
    with pytest.raises(ValueError, match="no turn at character 0"):
        chat.turns_of("x<|im_start|>user\n<|im_end|>\n")


def test_no_conversations(turns, spark):
    assert chat.read_back(chat.formatted(turns.limit(0))).collect() == []
    assert [r["conv_id"] for r in chat.read_back(chat.formatted(chat.with_controls(turns.limit(0)))).collect()] == [-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\\n>nau", max_size=8), st.text(alphabet="<|\\\n>im_endstart", max_size=30)), max_size=5))
def test_any_roles_and_texts_come_back(turns):
    text = "".join(s for role, said in turns for s, _ in chat.CHATML.segments(role, said))
    assert chat.turns_of(text) == turns
    assert all("<|" not in chat.escaped(said) for _, said in turns)
