import itertools
import random

import numpy as np

from quire.llm import langid

STEMS = {"aa": ["the", "ing", "er", "th", "ion", "and"], "bb": ["eau", "oux", "le", "que", "ent", "é"], "cc": ["sch", "ü", "ver", "keit", "en", "der"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=600):
    r = random.Random(4)
    return [(i, text(r, lang, r.randint(1, 120)) + (" 12 !" if i % 3 else ""), lang) for i, lang in ((i, r.choice(list(STEMS))) for i in range(n))]


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    sizes = np.array([3, 1, 4, 2])
    emit, trans = r.random((10, 3)) + 0.1, r.random((3, 3)) + 0.1
    gamma, pairs, log_z = langid.forward_backward(emit, sizes, trans)
    want_pairs, at = np.zeros((3, 3)), 0
    for c, n in enumerate(sizes):
        g, p, z = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.prod([emit[at + i, y] for i, y in enumerate(path)]) * np.prod([trans[a, b] for a, b in itertools.pairwise(path)])
            z += w
            for i, y in enumerate(path):
                g[i, y] += w
            for a, b in itertools.pairwise(path):
                p[a, b] += w
        assert np.allclose(gamma[at : at + n], g / z) and np.isclose(log_z[c], np.log(z))
        want_pairs += p / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(l, "x", 1, t, i) for i, t, l in rows], "lang string, lang_pred string, score int, text string, doc_id bigint")  # noqa: E741
    model = langid.train(df.where(~langid.held_out()))
    truth = {i: l for i, _, l in rows}  # noqa: E741
    got = langid.predict(df, model).where(langid.held_out()).collect()
    assert len(got) > 150
    assert sum(truth[x.doc_id] == x.lang_pred for x in got) / len(got) > 0.97
    assert all(0 <= x.score <= 1 for x in got)
    extra = df.union(spark.createDataFrame([("aa", "x", 1, None, 9001), ("aa", "x", 1, "1 2", 9002)], df.schema))
    kept = langid.keep_known(extra, model)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(truth)


def test_words_of_switched_text_are_labelled():
    r = random.Random(9)
    rows = [(t, l) for _, t, l in corpus()]  # noqa: E741
    languages = sorted(STEMS)
    model = langid.fit(langid.training_sequences(rows, languages), languages)
    words = langid.split_words(text(r, "aa", 30) + " " + text(r, "cc", 30))
    flat, begin, _ = langid._flat(words, model.numbers)
    score = np.add.reduceat(model.weights[flat], begin)
    gamma, _, _ = langid.forward_backward(np.exp(score - score.max(axis=1, keepdims=True)).astype(float), np.array([60]), np.exp(model.transitions))
    assert (gamma.argmax(axis=1) == [0] * 30 + [2] * 30).mean() > 0.95


def test_texts_in_no_language_learned_are_rejected(spark):
    """Clean texts stay, also short ones; texts of other syllables, letters and scripts go."""
    r = random.Random(21)
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert model.floor > 0.5
    other = ["kivu", "zopa", "wax", "jyk", "qo", "mub"]
    foreign = [(i, " ".join("".join(r.choice(other) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 80)))) for i in range(100)]
    foreign += [(100 + i, "".join(r.choice("bcdfgjklmpqrsvwxz ") for _ in range(200))) for i in range(50)] + [(200, "слово за словом " * 5), (201, "言葉 と 言葉 の 間 に 言葉")]
    clean = [(1000 + i, text(r, r.choice(list(STEMS)), r.randint(1, 60))) for i in range(300)]
    kept = {x.doc_id for x in langid.keep_known(spark.createDataFrame(foreign + clean, "doc_id bigint, text string"), model).collect()}
    assert not kept & {i for i, _ in foreign}
    assert len(kept & {i for i, _ in clean}) >= 298


def test_other_numbers_are_no_letters(spark):
    assert [langid.split_words(x) for x in ("½", "²x", "Ⅷ ①", "Ab9c_d", "日本 ñ")] == [[], ["x"], [], ["ab", "c", "d"], ["日本", "ñ"]]
    rows = spark.createDataFrame(corpus(200), "doc_id bigint, text string, lang string")
    got = langid.predict(spark.createDataFrame([(1, "½ Ⅷ 12")], "doc_id bigint, text string"), langid.train(rows)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_odd_texts_and_no_labels(spark):
    odd = [(1, None), (2, ""), (3, "12 .. 5"), (4, "the " * 30000), (None, "thing"), (5, "the"), (5, "the")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string")
    rows = spark.createDataFrame(corpus(200), "doc_id bigint, text string, lang string")
    got = langid.predict(df, langid.train(rows)).collect()
    assert len(got) == len(odd)
    for x in got:
        assert (x.lang_pred, x.score) == ("und", 0.0) if x.doc_id in (1, 2, 3) else x.lang_pred == "aa"
    assert langid.train(rows.limit(0)) is None
    assert {x.lang_pred for x in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), None).collect() == []
