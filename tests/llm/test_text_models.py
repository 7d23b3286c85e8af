"""Language identification and the quality model: brute force and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from tallyloom.llm import langid, quality

SYLLABLES = {"aa": "ka ko ki ta to".split(), "bb": "sch ung ein lich ber".split(), "cc": "ción ado que los ra".split()}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def corpus(seed, n=60, words=40):
    rng = random.Random(seed)
    return [(i, text_of(rng, lang, words), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.createDataFrame(corpus(1), "doc_id long, text string, lang string").select("text", "lang"))


def test_held_out_accuracy(spark, model):
    docs = spark.createDataFrame(corpus(2, words=8), "doc_id long, text string, truth string")
    got = langid.identify(docs, model).collect()
    assert sum(r.truth == r.lang_pred for r in got) >= 59 and all(0 <= r.score <= 1 for r in got)


def test_the_registered_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(docs, langid.train_on_folds(docs)).where((langid.fold() == 0) & F.col("lang").isNotNull()).collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150 and right >= 0.97 * len(got)


def test_mixtures(spark, model):
    rng = random.Random(7)
    both = " ".join(text_of(rng, x, 60) for x in ("aa", "cc"))
    got = langid.identify(spark.createDataFrame([(both,), (text_of(rng, "bb", 60),)], "text string"), model).collect()
    assert [r.languages for r in got] == ["aa,cc", "bb"]


def test_shares_are_those_of_plain_expectation_maximisation(model):
    rng = random.Random(8)
    where, n = langid.features(text_of(rng, "aa", 30) + " " + text_of(rng, "bb", 10))
    p = np.exp(np.array(list(model.values()))[:, where].astype(float))
    share = np.full(len(p), 1 / len(p))
    for _ in range(12):
        r = share[:, None] * p
        share = (r / r.sum(0) * n).sum(1) / n.sum()
    got, _ = langid.mixture(np.log(p), n.astype(float), np.array([0]), np.ones((1, len(p))), 12)
    assert np.allclose(got[0], share) and abs(share.sum() - 1) < 1e-9


def test_sets_and_answers_against_brute_force(model):
    """One text at a time, every k in turn: the sets, the answers and the scores of texts in one to three languages, inferred together."""
    rng = random.Random(18)
    names, log_p = list(model), np.array(list(model.values()))
    texts = [" ".join(text_of(rng, x, rng.choice((2, 30))) for x in rng.sample(list(SYLLABLES), k)) for k in (1, 1, 2, 2, 3, 3) for _ in range(4)] + [None, "", "12 !"]

    def fitted(p, n, allowed, rounds):
        share = allowed / allowed.sum()
        for _ in range(rounds):
            r = share[:, None] * p
            share = (r / r.sum(0) * n).sum(1) / n.sum()
        return share, float((n * np.log((share[:, None] * p).sum(0))).sum())

    def answer(text):
        where, n = langid.features(text)
        if not len(where):
            return (-1, 0.0, [])
        p, n = np.exp(log_p[:, where].astype(float)), n.astype(float)
        every, _ = fitted(p, n, np.ones(len(p)), 12)
        order, best = sorted(range(len(p)), key=lambda i: -every[i]), None
        for k in range(1, len(p) + 1):
            share, fit = fitted(p, n, np.array([float(i in order[:k]) for i in range(len(p))]), 1 if k == 1 else 12)
            fit -= 4.0 * k * math.log(n.sum() + 1)
            if best is not None and fit <= best[0]:
                break
            best = (fit, int(np.argmax(share)), sorted(order[:k]))
        return (best[1], min(1.0, every[best[1]]), best[2])

    got, want = langid.infer(texts, log_p), [answer(t) for t in texts]
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and np.allclose([s for _, s, _ in got], [s for _, s, _ in want])
    assert {len(c) for _, _, c in got} == {0, 1, 2, 3} and len(names) == 3


def test_null_ids_teach_nothing_and_are_not_held_out(spark, tmp_path):
    from tallyloom.llm import queries

    rows = [(i, f"ka ko {i}", "aa") for i in range(30)] + [(None, "sch ung", "bb"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_language_id(spark, f"file://{tmp_path}").collect()
    assert len(got) == 32 and all(r.held_out is not None for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in got} == {"aa", "und"}


def test_training_rows_do_not_include_the_held_out(spark):
    docs = spark.createDataFrame([(i, "ka" if i else "sch", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    import zlib

    assert set(langid.train_on_folds(docs)) == {f"l{i}" for i in range(40) if zlib.crc32(str(i).encode()) % 5}


def test_cases_and_slices(spark, model):
    got = langid.identify(cases.frame(spark), model)
    assert got.columns[-3:] == ["lang_pred", "score", "languages"] and got.count() == len(cases.rows())
    by_id = {r.doc_id: r for r in got.collect()}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (200, 201, 202, 203))
    assert langid.identify(cases.empty(spark), model).count() == 0
    assert {r.lang_pred for r in langid.identify(cases.frame(spark), {}).collect()} == {"und"}
    long = "ka to " * 500_000
    where, n = langid.features(long)
    short, m = langid.features("ka to " * 5)
    assert set(where) == set(short) and n.sum() > 1_900_000


# Kneser-Ney by the textbook.


def brute_model(words, order):
    sides = {k: {} for k in range(1, order + 1)}
    for w in words:
        for g in quality.grams(w, order):
            if len(g) == order or g[0] == quality.START:
                sides[len(g)][g] = sides[len(g)].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        left = {}
        for g in sides[k + 1]:
            if g[1:][0] != quality.START:
                left.setdefault(g[1:], set()).add(g[0])
        sides[k] |= {g: len(x) for g, x in left.items()}
    cuts = {}
    for k, table in sides.items():
        n = [sum(v == i for v in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cuts[k] = [0.0] + [max(0.0, min(i - 0.01, i - (i + 1) * y * n[i + 1] / n[i])) if n[1] and n[i] else 0.5 for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / (len(sides[1]) + 1)
        table, cut = sides[len(g)], cuts[len(g)]
        after = {x: v for x, v in table.items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total, held = sum(after.values()), sum(cut[min(v, 3)] for v in after.values())
        own = max(0.0, table[g] - cut[min(table[g], 3)]) if g in table else 0.0
        return own / total + held / total * p(g[1:])

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_probabilities_against_the_textbook(spark, order):
    rng = random.Random(order)
    train = [text_of(rng, "aa", 30) for _ in range(4)]
    texts = [*train, "kato zzz koki", "q", text_of(rng, "bb", 5)]
    p = brute_model([w for t in train for w in quality.words_of(t)], order)
    model = quality.train(spark.createDataFrame([("aa", t) for t in train], "lang string, text string"), order)
    docs = spark.createDataFrame([(i, "aa" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    want = [sum(math.log(p(g)) for w in quality.words_of(t) for g in quality.grams(w, order)) for t in texts]
    for bound in (10**6, 0):  # by broadcast, and by joins of shards
        got = {r.doc_id: r for r in quality.score(docs, model, order, bound).collect()}
        assert np.allclose([got[i].total for i in range(len(texts))], want)
        assert [got[i].events for i in range(len(texts))] == [sum(len(w) + 1 for w in quality.words_of(t)) for t in texts]
    seen = {g[:-1] for t in train for w in quality.words_of(t) for g in quality.grams(w, order)}
    signs = {g[-1] for t in train for w in quality.words_of(t) for g in quality.grams(w, order)}
    for context in list(seen)[:8]:
        assert sum(p(context + s) for s in signs) <= 1 + 1e-9


def test_clean_text_is_kept_and_junk_is_not(spark):
    rng = random.Random(9)
    rows = [(i, text_of(rng, lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(900, "x9#q zz!v 77k @@w " * 10, "aa"), (901, None, "aa"), (902, " ", "bb"), (903, text_of(rng, "aa", 40), "new"), (None, text_of(rng, "aa", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.classify(docs, spark.range(40).select(F.col("id").alias("doc_id"))).collect()}
    assert not any(got[i].kept for i in (900, 901, 902)) and got[901].perplexity is None and got[903].kept and got[None].kept
    assert sum(got[i].kept for i in range(80)) >= 79 and len(got) == len(rows)


def test_words_know_the_one_before():
    again = quality.AGAIN
    assert list(quality.words_of("a a b a a a")) == ["a", again + "a", "b", "a", again + "a", again + "a"]
    assert list(quality.words_of(f"x{quality.START}y{again}y")) == ["x", "y", again + "y"]
    assert list(quality.words_of("z" * 150)) == ["z" * 64, again + "z" * 64, "z" * 22] and list(quality.words_of(None)) == []


def test_what_is_kept_against_brute_force(spark):
    """The whole query's decisions: textbook probabilities, held-out thresholds, the fallback, on both paths."""
    rng = random.Random(12)
    rows = [(i, text_of(rng, lang, 12), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100 + i, text_of(rng, "cc", 12), "cc") for i in range(6)] + [(200, "kato " * 20, "aa"), (201, None, "aa"), (202, "q!7 " * 5, None), (203, " ", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(quality.held_out()).collect()}
    trusted = set(range(60))
    models = {lang: brute_model([w for i, t, x in rows if i in trusted - held and lang in (x, "") for w in quality.words_of(t)], 3) for lang in ("aa", "bb", "")}

    def perplexity(text, lang):
        p, grams = models[lang if lang in models else ""], [g for w in quality.words_of(text) for g in quality.grams(w, 3)]
        return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None

    value = {i: perplexity(t, x) for i, t, x in rows}
    limit = {lang: 1.1 * sorted(value[i] for i, _, x in rows if i in trusted & held and lang in (x, ""))[-1] for lang in ("aa", "bb", "")}
    for bound in (10**6, 0):
        got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), 1.0, 1.1, 3, bound).collect()}
        assert got.keys() == value.keys()
        for i, _, lang in rows:
            want = limit[lang if lang in limit else ""]
            assert math.isclose(got[i].threshold, want, rel_tol=1e-9) and (got[i].perplexity is None) == (value[i] is None)
            assert value[i] is None or math.isclose(got[i].perplexity, value[i], rel_tol=1e-9)
            assert got[i].kept == (value[i] is not None and value[i] <= want)
    assert not got[200].kept and got[5].kept


def test_quality_cases(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 20)], "doc_id long")
    got = quality.classify(cases.frame(spark), ids)
    assert got.count() == len(cases.rows())
    assert quality.classify(cases.empty(spark), ids).count() == 0
    assert quality.classify(cases.frame(spark), ids.where("false")).where("kept").count() == 0
