"""op7, op9, op10 and the pipeline: against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillflow.llm import ann, simhash, suffix_dedup
from quillflow.llm.components import components

from .conftest import ROWS, SCHEMA, rows_of


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def variants(seed=0):
    r = random.Random(seed)
    rows, vocabulary = [], ["".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    for _ in range(12):
        words = r.choices(vocabulary, k=400)
        for _ in range(r.randint(1, 8)):
            own = list(words)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(400)] = r.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(own), "en", "a"))
    return [*rows, (1, rows[0][1].upper(), "en", "a")]


@pytest.mark.parametrize("limit", [2048, 2])
def test_near_duplicates(spark, odd, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_VALUES", limit)
    rows = variants() + ROWS
    docs = spark.createDataFrame(rows_of(variants()), SCHEMA).unionByName(odd).repartition(4)
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {k: min((rows[j][0] for j in range(len(rows)) if root[j] == k and rows[j][0] is not None), default=None) for k in set(root)}
    expected = sorted((str(r[0]), f, str(least[k])) for r, f, k in zip(rows, prints, root))
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_bit_sliced_comparison():
    r = np.random.default_rng(2)
    values = r.integers(0, 2**63, 500).astype(np.uint64)
    values[250:] = values[:250] ^ (np.uint64(1) << r.integers(0, 64, 250).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 250).astype(np.uint64))
    planes = simhash.bit_planes(values)
    for v in values[::9]:
        assert (simhash.within_radius(planes, int(v))[:500] == (np.bitwise_count(values ^ v) <= 2)).all()


def test_bucket_masks_miss_no_pair():
    masks = simhash._masks(simhash.LEVELS)
    r = random.Random(4)
    for _ in range(300):
        differ = 1 << r.randrange(64) | 1 << r.randrange(64)
        level = [k for k, m in enumerate(masks[0]) if not m & differ]
        assert level
        for deeper in masks[1:]:
            level = [j for k in level for j in range(3 * k, 3 * k + 3) if not deeper[j] & differ]
            assert level
    assert max(64 - m.bit_count() for m in masks[-1]) <= 10


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    links = {"chain": [(k, k + 1) for k in range(60)], "star": [(7, k) for k in range(60) if k != 7], "random": [(r.randrange(80), r.randrange(80)) for _ in range(50)], "none": []}[shape]
    root = roots(100, links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {k for a, b in links if a != b for k in (a, b)}
    assert got == {k: root[k] for k in linked}


def test_empty_near_duplicates(empty):
    assert simhash.near_duplicates(empty).count() == 0


# ---- repeated passages


def plain_removal(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking up every 50 bytes of documents with smaller ids."""
    big = 10**20
    data = [((big if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    first = {}
    for d, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, big + 1), d)
    out = []
    for (d, b), r in zip(data, rows):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p] += 1
                gone[p + 50] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((str(r[0]), len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    r = random.Random(seed)
    text = lambda n, a="abcdé ": "".join(r.choices(a, k=n))
    shared = [text(n) for n in (49, 50, 51, 75, 76, 77, 120, 400)]
    rows = []
    for k in range(60):
        parts = [text(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, 10)
            parts += [s[a:] if r.random() < 0.5 else s, text(r.randint(0, 60))]
        rows.append((r.randrange(1000), "".join(parts), "en", "a"))
    rows += [(2000, "a" * 300, "en", "a"), (2001, "a" * 120, "en", "a"), (2002, "b" * 60 + "a" * 49, "en", "a"), (2003, "ab" * 100, "en", "a"), (5, rows[3][1], "en", "a"), (2004, rows[3][1], "en", "a")]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 256), (2, 256), (3, 0), (4, 1)])
def test_repeated_passages(spark, odd, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    rows = passages(seed) + ROWS
    docs = spark.createDataFrame(rows_of(passages(seed)), SCHEMA).unionByName(odd).repartition(5)
    got = suffix_dedup.repeats(docs, keep=("lang", "words"), with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_removal(rows)
    for r in got:
        assert len(r["spans"]) == 2 * r["n_spans"] and sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"] and r["words"] == "w"


def test_anchors_in_stretches(monkeypatch):
    r = np.random.default_rng(0)
    data = r.integers(97, 105, 20_000).astype(np.uint8)
    bounds = np.array([0, 30, 30, 5000, 5049, 5099, 20_000])
    whole = suffix_dedup.anchors(data, bounds)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    parts = suffix_dedup.anchors(data, bounds)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    for p in range(0, 20_000 - 50, 7):  # every 50 bytes of one text hold an anchor
        row = np.searchsorted(bounds, p, side="right") - 1
        if p + 50 <= bounds[row + 1]:
            assert ((whole[0] >= p) & (whole[0] <= p + 26)).any()


def test_periodic_texts_have_few_anchors_and_every_window_one():
    r = random.Random(1)
    for period in (1, 2, 3, 7, 13, 14, 20, 26, 27, 40):
        unit = "".join(r.choices("abcdef", k=period))
        texts = [(unit * 3000)[: r.randint(60, 3000)] for _ in range(6)] + [unit * (30_000 // period)]
        raw = "".join(texts).encode()
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        at, h = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), bounds)
        assert len(at) < len(raw) / 5 and len(at) == len(h)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = at[(at >= a) & (at <= b - 24)]
            starts = np.arange(a, b - 49)
            assert (np.searchsorted(own, starts + 26, side="right") > np.searchsorted(own, starts)).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periodic_passages(spark, monkeypatch, seed):
    """Periodic stretches of many lengths and phases, within and across texts, against every 50 bytes looked up."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 500)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", (256, 1, 0)[seed - 1])
    r = random.Random(seed)
    units = ["a", "ab", "abc", "aab", "".join(r.choices("abcd", k=9)), "".join(r.choices("abcd", k=17)), "".join(r.choices("ab", k=30))]
    rows = []
    for k in range(50):
        parts = []
        for _ in range(r.randint(1, 4)):
            u = r.choice(units)
            parts += ["".join(r.choices("abcd", k=r.randint(0, 20))), (u * 300)[r.randint(0, 20) :][: r.randint(30, 260)]]
        rows.append((r.randrange(400), "".join(parts), "en", "a"))
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3)
    got = suffix_dedup.repeats(docs).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == plain_removal(rows)


def test_largest_and_least_ids_and_nulls(spark):
    """The largest id is an id, and earlier than none at all."""
    top, low, word = 2**63 - 1, -(2**63), "".join(random.Random(5).choices("abcdefgh", k=90))
    ids = (None, top, top - 1, low, 0, None, top)
    rows = [(k, word[i:] if k is not None else word, "en", "a") for i, k in enumerate(ids)] + [(top, "only here " * 9, "en", "a"), (None, "only here " * 9, "en", "a")]
    got = suffix_dedup.repeats(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3)).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == plain_removal(rows)
    assert sum(x["doc_id"] == top for x in got) == 3 and sum(x["doc_id"] is None for x in got) == 3


def test_copies_of_whole_texts_send_no_snippets(spark, monkeypatch):
    """However many blocks a text stands in, it is one digest in each; rows of one id, and those of none, don't cut each other."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    sent, removals = [], suffix_dedup.removals
    monkeypatch.setattr(suffix_dedup, "removals", lambda rows, buckets: (sent.append(rows), removals(rows, buckets))[1])
    r = random.Random(9)
    texts = ["".join(r.choices("abcdefgh ", k=n)) for n in (49, 50, 51, 90, 400, 900)]
    for ids in (range(90), [r.choice((None, 7, 7, r.randrange(1000))) for _ in range(90)]):
        rows = [(k, texts[i % 6], "en", "a") for i, k in enumerate(ids)]
        got = suffix_dedup.repeats(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(4)).collect()
        assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == plain_removal(rows)
    assert sent[0].select("block").distinct().count() > 5 and sent[0].where("bucket >= 0").count() == 0


@pytest.mark.parametrize("most", [3, 20, 200_000])
def test_shards_follow_the_snippets(spark, monkeypatch, most):
    """Texts that share nothing need no shards, however long they are; the result is the same with any number."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SHARD_SNIPPETS", most, raising=False)
    shards, removals = [], suffix_dedup.removals
    monkeypatch.setattr(suffix_dedup, "removals", lambda rows, buckets: (shards.append(buckets), removals(rows, buckets))[1])
    r = random.Random(10)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    alone = [(k, text(300), "en", "a") for k in range(80)]
    common = text(200)
    for rows in (alone, alone + [(100 + k, text(r.randint(0, 40)) + common + text(30), "en", "a") for k in range(20)]):
        got = suffix_dedup.repeats(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(4)).collect()
        assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == plain_removal(rows)
    assert shards[0] == 4 and (shards[1] > 4) == (most <= 20)


@pytest.mark.parametrize(("hot", "places"), [(2, 16_000), (256, 16_000), (256, 40)])
def test_one_passage_in_every_document(spark, monkeypatch, hot, places):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_PLACES", places)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "ARRAY_SNIPPETS", 60)
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    common = text(300)
    rows = [(k, text(r.randint(0, 80)) + common + text(r.randint(0, 80)), "en", "a") for k in r.sample(range(10_000), 600)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(4)).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == plain_removal(rows)


@pytest.mark.parametrize("alphabet", [2, 3, 26])
def test_suffix_array_and_common_prefixes(alphabet):
    r = np.random.default_rng(alphabet)
    rows, width = 40, 30
    text, size = r.integers(1, alphabet + 1, (rows, width)), r.integers(5, width, rows)
    text[r.random((rows, width)) < 0.02] = 1
    text[7], size[7] = text[6], size[6]
    symbols = np.where(np.arange(width) < size[:, None], text + rows, np.arange(rows)[:, None])
    order = suffix_dedup.suffix_array(symbols.ravel(), width)
    flat = symbols.ravel().tolist()
    assert order.tolist() == sorted(range(rows * width), key=lambda k: flat[k:])
    shared = suffix_dedup.common_prefixes(symbols, size, order)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        most = min(max(0, size[x // width] - x % width) for x in (a, b))
        n = 0
        while n < most and flat[a + n] == flat[b + n]:
            n += 1
        assert shared[k] == n


@pytest.mark.parametrize("most", [7, 50, 10_000])
def test_arrays_of_one_anchor_merge(monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "ARRAY_SNIPPETS", most)
    r = np.random.default_rng(5)
    n, w = 300, suffix_dedup.SNIPPET
    text = r.integers(97, 100, (12, w)).astype(np.uint8)[r.integers(0, 12, n)]
    for k in range(n):
        if r.random() < 0.7:
            text[k, r.integers(0, w)] = r.integers(97, 123)
    size = np.where(r.random(n) < 0.2, 60, w)
    text[np.arange(w) >= size[:, None]] = 0
    doc = r.integers(0, 200, n)
    best = {}
    for k in range(n):
        for o in range(size[k] - 49):
            s = text[k, o : o + 50].tobytes()
            best[s] = min(best.get(s, 10**9), doc[k])
    low, high = suffix_dedup.extents(text, size, doc, np.zeros(n, np.int64))
    for k in range(n):
        own = [o for o in range(size[k] - 49) if best[text[k, o : o + 50].tobytes()] < doc[k]]
        assert (low[k], high[k]) == ((min(own), max(own) + 50) if own else (-1, -1))


def test_empty_repeats(empty):
    assert suffix_dedup.repeats(empty).count() == 0


# ---- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    vectors = {k: (centres[k % 12] + 0.3 * r.normal(size=16)).astype(np.float32) for k in range(1500)}
    for k in range(0, 1500, 3):  # a hot vector, queries among it
        vectors[k] = vectors[0]
    rows = [(k, v.tolist(), 1) for k, v in vectors.items()]
    bad = [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] + [1.0] * 15, 1), (5400, [], 1), (None, [1.0] * 16, 1), (5500, [float("inf")] * 16, 1), (5600, [1.0, 2.0], 1), (5601, [1.0, 2.5], 1), (300, vectors[300].tolist(), 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for x in ann.nearest(table, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    assert set(got) == {k for k in range(0, 1500, 100)} | {5600}
    assert [(n, v) for n, _, v in got[5600]] == [(1, 5601)]
    ids, data = np.array(list(vectors)), np.stack(list(vectors.values())).astype(float)
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((data - vectors[q].astype(float)) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = sorted(got[q])
        assert [n for n, _, _ in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, s, v in own)
        if q % 3 == 0:
            assert [v for _, _, v in own] == [ids[k] for k in best]
        hits += len({v for _, _, v in own} & set(ids[best].tolist()))
        total += 10
    assert hits / total >= 0.9


def recall_of(spark, data, k=10):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in ann.nearest(table, F.col("vec_id") % 100 == 0, k).collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    data, hits = data.astype(float), 0
    for q in range(0, len(data), 100):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(got[q]) & set(np.argsort(d)[:k].tolist()))
    return hits / k / len(range(0, len(data), 100))


@pytest.mark.parametrize("kind", ["clusters", "gaussian"])
def test_recall_over_many_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD_VECTORS", 150)
    r = np.random.default_rng(4)
    if kind == "clusters":  # one cluster with a third of all vectors: several shards of one centroid
        which = np.where(r.random(6000) < 1 / 3, 0, r.integers(0, 60, 6000))
        data = r.normal(size=(60, 32))[which] + 0.4 * r.normal(size=(6000, 32))
    else:
        data = r.normal(size=(6000, 24))
    assert recall_of(spark, data.astype(np.float32)) >= 0.9


def test_means_and_nearest_centroids():
    r = np.random.default_rng(2)
    data = (r.normal(size=(5, 8)) * 10)[r.integers(0, 5, 2000)] + 0.1 * r.normal(size=(2000, 8))
    centroids = ann.means(data.astype(np.float32), 5)
    near = ann.nearest_centroids(data.astype(np.float32), centroids, 3)
    d = ((data[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert np.take_along_axis(d, near, 1) == pytest.approx(np.sort(d, axis=1)[:, :3], rel=1e-3, abs=1e-2)


@pytest.mark.parametrize("n", [1, 2, 20, 400])
def test_graph_finds_nearest(n):
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 8)).astype(np.float32)
    graph, entries = ann.build_graph(v)
    assert graph.max() < n and ((graph >= 0).sum(axis=1) <= ann.DEGREE).all() and not (graph == np.arange(n)[:, None]).any()
    at, d = ann.beam_search(v, graph, entries, v[:50], ann.SEARCH_BEAM)
    assert (at[:, 0] == np.arange(min(50, n))).all() and (np.diff(np.where(np.isfinite(d), d, 1e9), axis=1) >= 0).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("vec_id") % 100 == 0, 10).count() == 0


# ---- pipeline


def test_near_duplicates_go_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, other = (" ".join(f"{w}{i * i % 97}" for i in range(80)) for w in ("alpha", "omega"))
    rows = [(1, one, "en", "a"), (2, one, "en", "a"), (2, other, "en", "b"), (3, one, "en", "a"), (None, one, "en", "a")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).select(*pipeline.COLUMNS)
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str((r["doc_id"], r["text"], r["source"], r["n_chars"])) for r in got) == sorted(str((k, t, s, len(t))) for k, t, s in ((1, one, "a"), (2, other, "b"), (None, one, "a")))


def test_pipeline(spark, odd, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(10_000 + k, t, "en", s) for k, (_, t, _, s) in enumerate(variants(3))] + [(20_000 + k, t, "en", "p") for k, (_, t, *_) in enumerate(passages(3))]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).unionByName(odd).select(*pipeline.COLUMNS).repartition(3)
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        after = docs.collect()
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"] or "") for r in after) and len(after) > 0.8 * len([r for r in before if r["text"] and any(map(str.isalpha, r["text"]))])
        if name == "simhash":
            named = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(before, docs.schema)).collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] is None or named[r["doc_id"]] == r["doc_id"])
        if name == "suffix_dedup":
            left = {d: n - g for d, n, g, *_ in plain_removal([(r["doc_id"], r["text"]) for r in before])}
            assert all(r["n_chars"] == len(r["text"]) for r in after) and {str(r["doc_id"]) for r in after} == {d for d, n in left.items() if n}
        if name == "mix_sources":
            assert {str(r) for r in after} <= {str(r) for r in before}
    packed = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()
    docs = empty.select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
