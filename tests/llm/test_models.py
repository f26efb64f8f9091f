"""op2, op3 and op8: learned models, against brute force and on held-out rows."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillflow.llm import hmm, lang_id, toxicity

from .conftest import ROWS, SCHEMA, rows_of

SOUNDS = {"en": "the of th ing er and on re in ed".split(), "de": "der ch sch und ei ung en ü ver ge".split(), "es": "de la que ción os ar ñ es el ado".split()}
BAD = ["idiotic", "vermin", "scumbag"]


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for k in range(450):
        lang, text = list(SOUNDS)[k % 3], None
        text = prose(lang, 20 + k % 60, k)
        if k % 5 == 0:
            text += " " + " ".join(random.Random(k).choices(BAD, k=3))
        rows.append((k, text, lang, "a"))
    return spark.createDataFrame(rows_of(rows), SCHEMA).repartition(4).cache()


# ---- language


def test_codes():
    c, off = lang_id.codes(pa.array([" Ab  c", None, "", "é!x", "1"]))
    assert [c[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[0, 0, 0, 97, 98, 0, 99, 0], [0] * 4, [0] * 4, [0, 0, 0, 233, 0, 120, 0], [0] * 4]


def test_letters_beyond_the_basic_planes():
    texts = ["\U00032000\U00032001 \U000323af", "\U00020000", "𐐀", "12 !?"]
    c, off = lang_id.codes(pa.array(texts))
    assert [sorted({int(x) for x in c[a:b] if x}) for a, b in zip(off[:-1], off[1:])] == [[0x32000, 0x32001, 0x323AF], [0x20000], [0x10428], []]
    letters = [x for x in range(0x110000) if chr(x).isalpha()]
    table = lang_id.code_table()
    assert (table[letters] != 0).all() and (table != 0).sum() == len(letters)
    assert all(table[x] == (ord(chr(x).lower()) if len(chr(x).lower()) == 1 else x) for x in letters)


def test_hash_array():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**60, 5000).astype(np.uint64))
    array, at = lang_id._merged([keys[:3000], keys[2000:]])
    union = np.concatenate([keys[:3000], keys[2000:]])[at]
    assert (union[array.find(keys)] == keys).all() and (array.find(keys[:50] + np.uint64(1)) == -1).sum() >= 49


class PlainKneserNey:
    """Interpolated Kneser-Ney over tuples in dictionaries, one character at a time."""

    def __init__(self, texts):
        self.levels, grams = {}, collections.Counter()
        for t in texts:
            chars = self.chars(t)
            for i in range(3, len(chars)):
                grams[tuple(chars[i - 3 : i + 1])] += 1
        for order in (4, 3, 2, 1):
            once, twice = (sum(n == k for n in grams.values()) for k in (1, 2))
            contexts = collections.defaultdict(list)
            for g, n in grams.items():
                contexts[g[:-1]].append(n)
            self.levels[order] = (grams, once / (once + 2 * twice) if once and twice else 0.5, contexts)
            grams = collections.Counter(g[1:] for g in grams)

    @staticmethod
    def chars(text):
        found = [0, 0, 0]
        for c in text:
            c = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
            if c or found[-1]:
                found.append(c)
        return [*found, 0] if len(found) > 3 else [0, 0, 0, 0]

    def prob(self, gram):
        if not gram:
            return 1 / lang_id.alphabet()
        grams, d, contexts = self.levels[len(gram)]
        same = contexts.get(gram[:-1])
        if not same:
            return self.prob(gram[1:])
        return max(grams[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * self.prob(gram[1:])

    def entropy(self, text):
        chars = self.chars(text)
        return -sum(math.log(self.prob(tuple(chars[i - 3 : i + 1]))) for i in range(3, len(chars))) / (len(chars) - 3)


def built(texts):
    return lang_id.build_block({k: lang_id._tuples(*lang_id.codes(pa.array(v))) for k, v in texts.items()})


@pytest.mark.parametrize("at_once", [7, 1 << 18])
def test_cross_entropies_against_plain_kneser_ney(monkeypatch, at_once):
    monkeypatch.setattr(lang_id, "EVENTS", at_once)
    texts = {"a": ["the thing then", "that  other", "THE", "the \U00032000 x"], "b": ["der den dem", "die Ümläute"], "c": ["12 34", "και το"]}
    plain = {k: PlainKneserNey(v) for k, v in texts.items()}
    asked = ["then", "dem the", "Ω", "ünd \U00032000\U00032001", "zzz και", "The, der.", "x" * 50]
    model = lang_id.Model(sorted(texts), [built({k: v}) for k, v in texts.items()], np.tile([0.0, 1.0, 0.0, np.inf], (3, 1)))
    c, off = lang_id.codes(pa.array(asked))
    n = lang_id.predicted(c, off)
    want = np.array([[plain[k].entropy(t) for k in sorted(texts)] for t in asked])
    assert -built(texts).sums(c, off) / n[:, None] == pytest.approx(want, rel=1e-4)
    for one in (model, lang_id.Model(sorted(texts), [built(texts)], model.limits)):  # blocks of one language, and one block
        lang, score, far = one.predict(pa.array(asked))
        assert lang.tolist() == [sorted(texts)[k] for k in want.argmin(axis=1)] and not far.any()
        gaps = (want - want.min(axis=1, keepdims=True)) * np.minimum(n, lang_id.SCORE_CHARS)[:, None]
        assert score == pytest.approx(1 / np.exp(-gaps).sum(axis=1), rel=1e-3)


def test_model_is_a_distribution():
    model = built({"a": ["the thing then", "that"], "b": ["der den dem", "die"]})
    letters = np.unique(lang_id.code_table())
    for context in ((0, 0, 0), (116, 104, 101), (122, 122, 122), (100, 101, 114)):
        every = np.array([[*context, x] for x in letters], np.uint32).ravel()
        assert np.exp(model.log_probs(every, np.arange(3, len(every), 4)).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_any_number_of_languages(spark, corpus, monkeypatch):
    """Blocks in memory and in files give what one block gives, and there may be any number of them."""
    rows = corpus.select("doc_id", "text", "lang")
    asked = corpus.limit(60).select("doc_id", "text")
    want = {r["doc_id"]: r for r in lang_id.identify(asked, lang_id.learn(rows)).collect()}
    for block, held in ((1, 4), (1, 1), (2, 1)):
        monkeypatch.setattr(lang_id, "BLOCK", block)
        monkeypatch.setattr(lang_id, "BLOCKS_HELD", held)
        for r in lang_id.identify(asked, lang_id.learn(rows)).collect():
            assert (r["lang_pred"], r["rejected"]) == (want[r["doc_id"]]["lang_pred"], want[r["doc_id"]]["rejected"]) and r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-3)
    monkeypatch.undo()
    many = rows.unionByName(spark.range(130).selectExpr("id + 10000 doc_id", "concat('abc', id) text", "concat('zz', id) lang"))
    model = lang_id.learn(many)
    assert len(model.languages) == 133 and len(model.blocks) == 9 and all(isinstance(x, str) for x in model.blocks)
    assert model.predict(pa.array([prose("de", 60, 77)]))[0][0] == "de"


def test_hot_ids_do_not_fill_one_window(spark):
    rows = [(7, "the same thing", "en")] * 300 + [(7, f"other {k}", "en") for k in range(300)] + [(None, "null", "en")] * 300
    got = lang_id.picked(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50).collect()
    assert len(got) <= 50 and len({r["text"] for r in got}) == len(got) and sorted(r["place"] for r in got) == list(range(1, len(got) + 1))


def test_repeated_rows_take_no_places_of_others(spark):
    once = spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    many = once.unionByName(spark.range(900).selectExpr("id as doc_id", "concat('mot ', id) as text", "'fr' as lang"))
    rows = many.crossJoin(spark.range(300).where("id >= 0")).select("doc_id", "text", "lang")
    got = lang_id.picked(rows, 500).collect()
    assert len({r["text"] for r in got if r["lang"] == "en"}) == 400 and len([r for r in got if r["lang"] == "fr"]) == 500
    alone = lang_id.picked(many, 500).collect()
    assert sorted(got) == sorted(alone)


def test_languages_of_held_out_rows(spark, corpus):
    model = lang_id.learn(corpus.where("doc_id % 4 <> 2"), train_rows=100, calibration_rows=25)
    got = lang_id.identify(corpus.where("doc_id % 4 = 2"), model, ("doc_id", "lang", "score_", "text")[:2]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and not any(r["rejected"] for r in got)
    strange = spark.createDataFrame(rows_of([(1, "xzqj wkvv qqq zzxx jjkw pqx " * 20, None, "a")]), SCHEMA)
    assert lang_id.identify(strange, model).first()["rejected"]


def test_limits_with_mislabelled_calibration_rows():
    rng = np.random.default_rng(4)
    for rows, bad in ((500, 8), (50, 1), (20, 1)):
        h, n = rng.normal(2, 0.1, rows), rng.integers(50, 2000, rows)
        h[rng.choice(rows, bad, replace=False)] = rng.uniform(6, 9, bad)  # other languages, or junk
        model = lang_id.Model(["en"], [], np.array([[0.0, 1.0, 0.0, np.inf]]))
        lang_id.calibrate(model, np.full(rows, "en", object), h, n)
        mean, wide, narrow, most = model.limits[0]
        assert (5 - mean) / math.sqrt(wide + narrow / 1000) > most, (rows, model.limits)  # a text like the junk, and nearer
        good = (rng.normal(2, 0.1, 1000) - mean) / math.sqrt(wide + narrow / 1000)
        assert (good < most).mean() > 0.99


def test_languages_of_few_rows_reject(spark, corpus):
    greek = lambda n, seed: " ".join("".join(random.Random(f"{seed} {i}").choices(["και", "το", "ου", "ης", "αν", "ερ"], k=2)) for i in range(n))
    strange = ["жщц шчь ъыэ юяж " * 30, "xzqj wkvv qqq zzxx jjkw pqx " * 20]
    few = [(k, prose(lang, 60, k), lang, "a") for k, lang in enumerate(list(SOUNDS) * 8)]
    for rows in (few, few + [(1000, greek(60, 0), "el", "a")], [(1000, greek(60, 0), "el", "a")]):
        model = lang_id.learn(spark.createDataFrame(rows_of(rows), SCHEMA))
        assert np.isfinite(model.limits).all()
        assert model.predict(pa.array(strange))[2].all(), model.limits
        fresh = [prose(lang, 60, 900 + k) for k, lang in enumerate(list(SOUNDS) * 5)] if len(rows) > 1 else []
        fresh += [greek(60, 5 + k) for k in range(10)] if rows[-1][2] == "el" else []
        assert not model.predict(pa.array(fresh))[2].any(), model.limits
    model = lang_id.learn(corpus.unionByName(spark.createDataFrame(rows_of([(1000 + k, greek(60, k), "el", "a") for k in range(10)]), SCHEMA)))
    assert model.predict(pa.array(strange))[2].all() and not model.predict(pa.array([greek(60, 50 + k) for k in range(10)]))[2].any()


def test_language_of_odd_rows(corpus, odd, empty):
    model = lang_id.learn(corpus)
    got = lang_id.identify(odd, model, ("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1 and (letters or r["rejected"])
    assert lang_id.identify(empty, model).count() == 0
    assert lang_id.learn(empty) is None
    assert {r["lang_pred"] for r in lang_id.identify(odd, None).collect()} == {"und"}


# ---- toxicity


def test_toxic_rows_stand_out(spark, corpus, odd, empty):
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 450, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(corpus.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1 or doc_id is null"))
    got = toxicity.score(corpus.where("doc_id % 3 = 1"), model).collect()
    bad, clean = [r["score"] for r in got if r["doc_id"] % 5 == 0], [r["score"] for r in got if r["doc_id"] % 5]
    above = sum(x > y for x in bad for y in clean) / len(bad) / len(clean)
    assert above > 0.95 and not any(y >= toxicity.THRESHOLD for y in clean), above
    odd_rows = toxicity.score(odd, model).collect()
    assert len(odd_rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd_rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.learn(corpus, labels.where("toxic = 0")) is None and toxicity.learn(empty, labels) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_scores_follow_the_toxic_share_above_the_bound_on_rows(spark):
    r, rows = random.Random(11), []
    for k in range(4000):
        toxic = k % 20 == 0
        text = " ".join(r.choices(["tree", "stone", "river", "cloud", "road", "field"], k=4))
        rows.append((k, text + (" vermin" if r.random() < (0.6 if toxic else 0.05) else ""), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    share = sum(t for _, x, t in rows if "vermin" in x) / sum("vermin" in x for _, x, _ in rows)
    probe = spark.createDataFrame([(0, "river stone vermin"), (1, "river stone")], "doc_id long, text string")
    for most in (4000, 100):  # all labelled rows, and a few of them
        model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most)
        got = {x["doc_id"]: x["score"] for x in toxicity.score(probe, model).collect()}
        assert abs(got[0] - share) < 0.2 and got[1] < 0.1, (most, got, share)


def test_labels_of_other_documents_change_nothing(spark, corpus):
    docs = corpus.select("doc_id", "text")
    own = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    other = spark.range(100_000, 130_000).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.learn(docs, x)).collect())) for x in (own, own.unionByName(other)))
    assert a == b


def test_bound_on_labelled_rows_is_exact_whatever_repeats(spark):
    """A labelled id with half of all rows, equal ones and others: at most the bound, of least hash, in any order of rows."""
    rows = [(7, f"vermin {k % 400}" if k % 2 else "vermin same") for k in range(2000)] + [(k, f"text {k}") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    picked = docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text, 2) pick")
    want = [r["text"] for r in picked.orderBy("pick").limit(50).collect()]
    for parts in (1, 5):
        got = toxicity._told(picked.repartition(parts), 50)
        assert [x.tolist() for x in got] == [toxicity.features(pa.array([t]))[1].tolist() for t in want]


def test_products_cover_all_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 40)
    texts = [r[1] for r in ROWS]
    each = [set(toxicity.features(pa.array([t], pa.string()))[1].tolist()) for t in texts]
    every = sorted(set().union(*each))
    wanted = np.zeros(1 << toxicity.HASH_BITS, bool)
    wanted[every[::3]] = True
    n, rows = toxicity.frequencies(odd, wanted)
    assert rows == len(ROWS) and {h: int(n[h]) for h in np.flatnonzero(n)} == {h: sum(h in x for x in each) for h in every[::3]}
    column = np.full(1 << toxicity.HASH_BITS, -1, np.int16)
    column[every[:40]] = np.arange(40)
    got = toxicity.products(odd, column, 40)
    assert got.tolist() == [[float(sum(a in x and b in x for x in each)) for b in every[:40]] for a in every[:40]]


def pu_risk(w, b, positive, unlabelled, prior, clip=True):
    f, g = positive @ w + b, unlabelled @ w + b
    negative = ((1 + g) ** 2).mean() - prior * ((1 + f) ** 2).mean()
    return prior * ((1 - f) ** 2).mean() + (max(0.0, negative) if clip else negative) + toxicity.RIDGE * w @ w, negative


@pytest.mark.parametrize(("n", "d", "prior", "seed"), [(200, 5, 0.3, 0), (12, 30, 0.2, 1), (40, 60, 0.05, 2), (5, 3, 0.9, 3)])
def test_least_non_negative_risk(n, d, prior, seed):
    """No step in any direction lowers the risk; where few positives would drive it below zero, it is held at zero."""
    rng = np.random.default_rng(seed)
    p = (rng.random((n, d)) < 0.5).astype(np.float32)
    u = (rng.random((400, d)) < 0.3).astype(np.float32)
    p[:, 0] = 1
    w, b = toxicity.nn_pu(p, (u.T @ u).astype(float) / len(u), prior)
    least, negative = pu_risk(w, b, p, u, prior)
    assert negative > -1e-6
    for _ in range(300):
        step = rng.normal(0, 10.0 ** rng.integers(-5, 0), d + 1)
        assert pu_risk(w + step[:-1], b + step[-1], p, u, prior)[0] >= least - 1e-6
    if negative > 1e-3:  # the correction isn't at work: the gradient is zero
        grad = [(pu_risk(w + e[:-1], b + e[-1], p, u, prior)[0] - pu_risk(w - e[:-1], b - e[-1], p, u, prior)[0]) / 2e-4 for e in np.eye(d + 1) * 1e-4]
        assert np.abs(grad).max() < 1e-4
    assert (p @ w + b).mean() > (u[u[:, 0] == 0] @ w + b).mean()


def test_toxicity_with_few_labels(spark, corpus):
    for ids in ([0], [0, 5], [0, 5, 10]):
        labels = spark.createDataFrame([(k, 1) for k in ids], "doc_id long, toxic int")
        got = [r["score"] for r in toxicity.score(corpus, toxicity.learn(corpus, labels)).collect()]
        assert len(got) == 450 and all(0 <= x <= 1 for x in got)


def test_word_features_are_distinct_and_caseless():
    row, h = toxicity.features(pa.array(["Trash, TRASH! x", None, "", "trash"]))
    assert (row == 0).sum() == 2 and (row == 3).sum() == 1 and set(h[row == 3]) < set(h[row == 0])


# ---- language model


def groups_of(lengths, codes):
    ends = np.cumsum(lengths)
    return hmm.arranged([codes[b - n : b].astype("<u2").tobytes() for n, b in zip(lengths, ends)])


def test_forward_and_backward_against_all_paths():
    rng = np.random.default_rng(3)
    m = hmm.Model.first(rng.random(hmm.CLASSES) * 10)
    seqs = [rng.integers(0, 30, n) for n in (3, 1, 4, 3, 2)]
    sizes, codes = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    got, starts, moves, emits = hmm.log_likelihoods(m, sizes, codes), np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, hmm.CLASSES))
    for s, v in zip(seqs, got):
        paths = list(itertools.product(range(hmm.STATES), repeat=len(s)))
        p = np.array([m.start[q[0]] * m.emit[q[0], s[0]] * math.prod(m.move[q[t - 1], q[t]] * m.emit[q[t], s[t]] for t in range(1, len(s))) for q in paths])
        assert math.log10(p.sum()) == pytest.approx(v)
        for q, x in zip(paths, p / p.sum()):
            starts[q[0]] += x
            for t in range(len(s)):
                emits[q[t], s[t]] += x
                if t:
                    moves[q[t - 1], q[t]] += x
    a, b, c = hmm.expected_counts(m, groups_of(sizes, codes))
    assert a == pytest.approx(starts, abs=1e-4) and b == pytest.approx(moves, abs=1e-4) and c == pytest.approx(emits, abs=1e-4)


def plain_forward_backward(m, s):
    """Starts, moves, emissions and log10 likelihood of one text, a token at a time in double precision."""
    alpha, scale = np.empty((len(s), hmm.STATES)), np.empty(len(s))
    for t, x in enumerate(s):
        alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * m.emit[:, x]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    beta, moves, emits = np.ones((len(s), hmm.STATES)), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, hmm.CLASSES))
    for t in range(len(s) - 2, -1, -1):
        follow = m.emit[:, s[t + 1]] * beta[t + 1] / scale[t + 1]
        beta[t] = m.move @ follow
        moves += alpha[t][:, None] * m.move * follow
    for t, x in enumerate(s):
        emits[:, x] += alpha[t] * beta[t]
    return alpha[0] * beta[0], moves, emits, np.log10(scale).sum()


@pytest.mark.parametrize(("long_", "segment", "at_once"), [(4096, 256, 600_000), (10, 4, 50), (1, 3, 7), (25, 25, 1000)])
def test_whole_texts_whatever_the_segments(monkeypatch, long_, segment, at_once):
    monkeypatch.setattr(hmm, "LONG", long_)
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    m = hmm.Model.first(rng.random(hmm.CLASSES) * 10)
    seqs = [rng.integers(0, 60, n) for n in (1, 300, 2, 51, 10, 11, 24, 25, 26, 97, 4, 12, 1000)]
    seqs += [seqs[1], seqs[2], seqs[1], seqs[4]]  # equal texts each count
    sizes, codes = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    want = [plain_forward_backward(m, s) for s in seqs]
    assert hmm.log_likelihoods(m, sizes, codes) == pytest.approx([w[3] for w in want])
    for got, k in zip(hmm.expected_counts(m, groups_of(sizes, codes)), range(3)):
        assert got == pytest.approx(sum(w[k] for w in want), rel=2e-4, abs=2e-4)


def test_each_step_of_a_group_has_texts_enough():
    lengths = np.repeat([500, 1500, 4000], 1500)
    found = list(hmm._groups(lengths))
    assert sorted(np.concatenate(found)) == list(range(len(lengths)))
    full = [g for g in found if lengths[g].min() == lengths[g].max()]
    assert len(full) > 10 and min(map(len, full[:-1])) >= 290  # 75 texts of 4,000 tokens shared a step once, and its calls took most of the time
    assert max(lengths[g].sum() for g in found) <= hmm.TOKENS_AT_ONCE * hmm.LONG / hmm.COUNTED + hmm.LONG
    assert max(map(len, hmm._groups(np.full(200, 20_000)))) <= hmm.TOKENS_AT_ONCE // 20_000  # longer ones go by segments


def test_moves_over_ranges_of_steps(monkeypatch):
    for at_once in (4, 12, 10_000):
        monkeypatch.setattr(hmm, "SUMMED", at_once)
        for steps in ([1], [3], [3, 3], [5, 5, 5, 5, 2, 2, 1], [4, 3, 2, 1], [6] * 9):
            pairs = []
            for t, stop in hmm._steps_alike(steps):
                assert steps[stop] == steps[t] or stop == t + 1
                pairs += [(k, steps[k + 1]) for k in range(t, stop)]
            assert pairs == [(k, steps[k + 1]) for k in range(len(steps) - 1)]


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(1, 40, 30) + 100 * (k % 3) for k in range(90)]
    sizes, codes = np.array([30] * 90), np.concatenate(seqs)
    m, last = hmm.Model.first(np.bincount(codes, minlength=hmm.CLASSES)), -np.inf
    for _ in range(8):
        now = hmm.log_likelihoods(m, sizes, codes).sum()
        assert now > last - 1e-6 * abs(now)
        last, m = now, hmm.Model.from_counts(*hmm.expected_counts(m, groups_of(sizes, codes)))


def test_every_pass_sees_all_training_texts(spark):
    rng = np.random.default_rng(9)
    texts = [rng.integers(1, 30, 3) + 40 * (k % 100 == 0) for k in range(6000)]  # a rare kind among more texts than any sample once had
    by_class = np.bincount(np.concatenate(texts), minlength=hmm.CLASSES)
    t = hmm.Totals(int(by_class.sum()) + len(texts), 60, len(texts), by_class, (by_class > 0).astype(np.int64))
    blobs = [np.append(x, 0).astype("<u2").tobytes() for x in texts]
    rows = spark.createDataFrame([(k, True, 4, bytearray(b)) for k, b in enumerate(blobs)], "doc_id long, train boolean, n_tokens long, classes binary").repartition(4).cache()
    got = hmm.train(rows, t)
    classes = by_class.astype(float)
    classes[0] = len(texts)
    want = hmm.Model.first(classes)
    lengths, codes = np.full(6000, 4), np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
    for _ in range(15):
        want = hmm.Model.from_counts(*hmm.expected_counts(want, groups_of(lengths, codes)))
    assert hmm.log_likelihoods(got, lengths, codes) == pytest.approx(hmm.log_likelihoods(want, lengths, codes), abs=2e-3)


def test_scores(spark, corpus, odd, empty):
    docs = corpus.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).selectExpr("doc_id", "text", "coalesce(doc_id, 0) % 5 <> 1 as train")
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in hmm.language_model_scores(docs).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    words = lambda t: (t or "").encode().translate(hmm._LOWER).split()
    count, texts = collections.Counter(w for r in rows if r["train"] for w in words(r["text"])), sum(r["train"] for r in rows)
    n, v = sum(count.values()) + texts, len(count) + 1
    low = math.log10(n + 0.5 * (v + 1))
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        w = words(r["text"])
        base = sum(math.log10(count[x] + 0.5) - low for x in w) + math.log10(texts + 0.5) - low
        found = got[r["doc_id"], len(w) + 1]
        assert any(x["base_score"] == pytest.approx(base) and x["n_known"] == sum(count[y] > 0 for y in w) + 1 and x["train_tokens"] == n for x in found)
    held = [x for y in got.values() for x in y if not x["train"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert hmm.language_model_scores(empty.selectExpr("doc_id", "text", "true as train")).count() == 0
    none = hmm.language_model_scores(odd.selectExpr("doc_id", "text", "false as train")).collect()
    assert len(none) == len(ROWS) and all(x["n_known"] == 0 and x["train_tokens"] == 0 for x in none)


def test_classes_cover_the_words():
    assert hmm.word_class(b"the") == hmm.word_class(b"the,") != hmm.word_class(b"of")
    assert hmm.word_class(b"walking") == hmm.word_class(b"talking.") and 1 <= hmm.word_class(b"...") < hmm.CLASSES
    assert zlib.crc32(b"x") == zlib.crc32(b"x")
