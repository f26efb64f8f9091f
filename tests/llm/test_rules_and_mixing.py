"""op5 and op6: DataFrame operations against plain Python."""

import hashlib
import math
import re

import pytest

from quillflow.llm import mixing, quality

from .conftest import ROWS, SCHEMA, rows_of


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(words) < 500 else {j for i, w in enumerate(windows) if _counts(windows)[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


_cache = {}


def _counts(windows):
    if id(windows) not in _cache:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        _cache.clear()
        _cache[id(windows)] = seen
    return _cache[id(windows)]


def test_base_counts(odd):
    got = sorted(tuple(-1 if x is None else x for x in (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in quality.judge(odd).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *base(r[1])) for r in ROWS)


def test_base_verdict_and_divergence(spark):
    prose = " ".join(["the man of the house and a dog in it was on with that is to be by for as"] * 3 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)])
    rows = [(k, " ".join(sorted(prose.split(), key=lambda w: hashlib.md5(f"{k}{w}".encode()).digest())), "en", "a") for k in range(30)]
    rows += [(100, re.sub(r"\s", "### ", rows[0][1]), "en", "a"), (101, "A|B " * 60, "en", "a"), (102, "the end", "en", "a"), (103, rows[1][1].upper(), "en", "a")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert not got[100]["kept"] and not got[100]["base_failed"] and not got[103]["kept"]
    assert got[101]["base_failed"] and got[102]["base_failed"] and not got[102]["kept"]
    assert sum(got[k]["kept"] for k in range(30)) >= 25 and got[102]["word_distance"] is None


def test_js_distance(spark):
    def plain(a, b):
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        return math.sqrt(sum((x * math.log2(2 * x / (x + y)) if x else 0) / 2 + (y * math.log2(2 * y / (x + y)) if y else 0) / 2 for x, y in zip(p, q)))

    pairs = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 5]), ([2, 4], [1, 2])]
    rows = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r[0] for r in rows.select(quality.js_distance(rows.a, rows.b)).collect()]
    assert got == pytest.approx([plain(*x) for x in pairs], abs=1e-7)


def test_empty_tables(empty):
    assert quality.judge(empty).count() == 0 and mixing.mix(empty).count() == 0


def fill(sizes, weights=(5, 2, 1)):
    """Shares by weight, capped at three times the size, the excess shared anew until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, full = {s: weights[k % 3] for k, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rate = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if rate * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else rate * w[s] for s in names}
        full |= over


@pytest.mark.parametrize("shape", ["odd", "many", "hot", "one", "shared", "equal", "nameless"])
def test_mix(spark, odd, shape):
    made = {
        "many": [(k, "w " * (k % 17), "en", f"s{k % 25}") for k in range(2000)],
        "hot": [(k, "w " * (1 + k % 5), "en", "hot" if k % 3 else None if k % 2 else f"t{k % 10}") for k in range(1500)],
        "one": [(1, "a b c", "en", "only")],
        "shared": [(7, f"w{k} " * (1 + k % 9), "en", f"s{k % 4}") for k in range(800)],
        "equal": [(None if k % 2 else 7, "a b c", "en", f"s{k % 3}") for k in range(900)] + [(k, "w", "en", "s3") for k in range(5)],
        "nameless": [(None, "a b c d e" if k % 2 else f"w{k}", "en", None if k % 3 else "a") for k in range(700)],
    }
    docs = odd if shape == "odd" else spark.createDataFrame(rows_of(made[shape]), SCHEMA).repartition(4)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    sizes, taken, most = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert 0 <= r["copies"] <= 3
    want = fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    # whatever parts the rows lie in, the same rows come as often
    again = mixing.mix(docs.repartition(1)).collect()
    plain = lambda rows: sorted(str((r["doc_id"], r["source"], r["size"], r["h"], r["copies"])) for r in rows)
    assert plain(got) == plain(again)
    whole = docs.select("doc_id", "text", "source", "score")
    by_hash = {(r["source"], r["h"]): (r["doc_id"], r["text"] or "") for r in whole.withColumn("h", mixing.row_hash(whole.doc_id, whole.text)).collect()}
    want = sorted(str((*by_hash[r["source"], r["h"]], r["source"])) for r in got for _ in range(r["copies"]))
    assert sorted(str((r["doc_id"], r["text"] or "", r["source"])) for r in mixing.mixed_rows(whole).collect()) == want


def test_larger_budgets_keep_what_smaller_ones_take(spark):
    docs = spark.createDataFrame(rows_of([(k, "w " * (1 + k % 9), "en", f"s{k % 3}") for k in range(900)]), SCHEMA)
    got = mixing.mix(docs).collect()
    for s in {r["source"] for r in got}:
        own = sorted((r for r in got if r["source"] == s), key=lambda r: r["hash"])
        assert [r["copies"] for r in own] == sorted((r["copies"] for r in own), reverse=True)
