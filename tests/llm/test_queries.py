"""Every registered query and the pipeline, run as registered over one small folder of tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import hmm, lang_id, queries, toxicity
from quillflow.llm.queries import QUERIES

from .conftest import ROWS, SCHEMA, rows_of
from .test_duplicates_and_search import plain_removal
from .test_models import PlainKneserNey, groups_of, plain_forward_backward, prose

CONTRACT = {
    "op1": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7": "query_id bigint, rank int, vec_id bigint, score double",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "doc_id bigint, fingerprint string, component_id bigint",
    "op10": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
}


def made_rows():
    r, rows = random.Random(2), []
    for k in range(100, 220):
        lang = ("en", "de", "es")[k % 3]
        text = prose(lang, 60, k) + (" vermin scumbag" if k % 6 == 0 else "")
        rows.append((k, text, lang, f"s{k % 4}"))
    rows += [(300 + k, rows[k][1], rows[k][2], "s0") for k in range(10)]
    rows.append((400, " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=3000)), "en", "s1"))
    return rows + [x for x in ROWS if x[0] != 10]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = made_rows()
    spark.createDataFrame(rows_of(rows), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = np.random.default_rng(1).normal(size=(300, 8))
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(k, rows[k][1][:200]) for k in range(5)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k % 9, k // 9, "assistant" if k // 9 % 2 else "user", x[1]) for k, x in enumerate(rows[:50])], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def got(spark, folder):
    made = {name: query(spark, folder) for name, query in QUERIES.items()}
    return {name: (x.dtypes, x.collect()) for name, x in made.items()}


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def test_columns_and_rows(got):
    rows = made_rows()
    for name, (types, found) in got.items():
        op = name.split("_")[0]
        assert dict(x.split() for x in CONTRACT[op].split(", ")).items() <= dict(types).items(), name
        if op not in ("op4", "op7", "op12"):
            assert collections.Counter(str(r["doc_id"]) for r in found) == collections.Counter(str(r[0]) for r in rows), name
    assert {str(r["doc_id"]) for r in got["op4_best_fit_packing"][1]} == {str(r[0]) for r in rows}
    assert sorted(r["conv_id"] for r in got["op12_chat_format"][1]) == list(range(-1, 9))
    assert len(got["op7_nearest_vectors"][1]) == 3 * 10 and set(queries.ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(("op", "modulus", "rest"), [("op2_toxicity", 3, 1), ("op3_language_id", 4, 2), ("op8_hmm_scores", 5, 1)])
def test_folds(got, op, modulus, rest):
    assert all(r["held_out"] == (fold(r["doc_id"], modulus) == rest) for r in got[op][1])


def test_verdicts(got):
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got["op2_toxicity"][1])
    clean, bad = ([r["score"] for r in got["op2_toxicity"][1] if 100 <= (r["doc_id"] or 0) < 220 and (r["doc_id"] % 6 == 0) == x and r["held_out"]] for x in (False, True))
    assert min(bad) > max(clean)
    cut = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got["op10_suffix_dedup"][1])
    assert cut == plain_removal([(r[0], r[1]) for r in made_rows()])


def test_languages_against_plain_kneser_ney(got):
    """The whole prediction: dictionaries of all teaching rows but those that calibrate; texts of the learned languages."""
    rows = [r for r in made_rows() if r[1] and any(c.isalpha() for c in r[1])]
    found = {r["doc_id"]: r for r in got["op3_language_id"][1]}
    texts = collections.defaultdict(list)
    for doc_id, text, lang, _ in rows:
        if lang in ("en", "de", "es") and fold(doc_id, 4) != 2 and len(text) < 5000:
            texts[lang].append(text)
    plain = {k: PlainKneserNey(v) for k, v in texts.items()}
    for doc_id, text, lang, _ in rows:
        if 100 <= (doc_id or 0) < 112:
            entropy = {k: p.entropy(text[:400]) for k, p in plain.items()}
            assert found[doc_id]["lang_pred"] == min(entropy, key=entropy.get) == lang


def test_scores_against_plain_forward(got):
    """The query's scores from its own method written plainly: counts in a dictionary, training a text at a time."""
    rows = made_rows()
    words = lambda t: (t or "").encode().translate(hmm._LOWER).split()
    teaching = [words(r[1]) for r in rows if fold(r[0], 5) != 1]
    count = collections.Counter(w for x in teaching for w in x)
    by_class, known = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in count.items():
        by_class[hmm.word_class(w)] += n
        known[hmm.word_class(w)] += 1
    coded = [np.array([*map(hmm.word_class, x), 0]) for x in teaching]
    classes = by_class.copy()
    classes[0] = len(teaching)
    model = hmm.Model.first(classes)
    for _ in range(hmm.PASSES):
        model = hmm.Model.from_counts(*hmm.expected_counts(model, groups_of(np.array([len(x) for x in coded]), np.concatenate(coded))))
    found = collections.defaultdict(list)
    for r in got["op8_hmm_scores"][1]:
        found[r["doc_id"], r["n_tokens"]].append(r["score"])
    for doc_id, text, *_ in rows:
        own = words(text)
        want = plain_forward_backward(model, np.array([*map(hmm.word_class, own), 0]))[3] if len(own) < 500 else hmm.log_likelihoods(model, np.array([len(own) + 1]), np.array([*map(hmm.word_class, own), 0]))[0]
        want += sum(math.log10((count[w] + 0.5) / (by_class[c] + 0.5 * (known[c] + 1))) for w, c in zip(own, map(hmm.word_class, own)))
        assert any(x == pytest.approx(want, rel=1e-3, abs=0.05) for x in found[doc_id, len(own) + 1]), doc_id


def test_texts_longer_than_every_slice(spark, folder, got, monkeypatch):
    """With slices far below the longest text, all is as before."""
    for module, name, value in ((toxicity, "SLICE_BYTES", 500), (lang_id, "SLICE_BYTES", 700), (lang_id, "EVENTS", 333), (hmm, "BATCH_BYTES", 2500)):
        monkeypatch.setattr(module, name, value)
    for name, keys in (("op2_toxicity", ("doc_id", "score")), ("op3_language_id", ("doc_id", "lang_pred", "rejected")), ("op8_hmm_scores", ("doc_id", "n_known", "base_score"))):
        plain = lambda rows: sorted(str(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in keys)) for r in rows)  # noqa: E731, B023
        assert plain(QUERIES[name](spark, folder).collect()) == plain(got[name][1])


def test_whole_pipeline(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in pipeline.STAGES[-1][1](spark, docs, folder).collect())
    found = pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in found) == want
    sizes = collections.Counter()
    for r in found:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 4096 and docs.where(F.col("text").isNull()).count() == 0
