import random
import re
from collections import Counter

import numpy as np

from quire.llm import quality

TEXTS = [None, "", "  \n ", "a b c a b c", "one\ntwo\none\n\n one\n", "x " * 3000, "é è # & <b>\x0bq\x1fz", "a b c d", "w", "p q r p q r s\np q r", "# " * 60]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), len(lines)


def test_statistics_equal_brute_force():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab c\n\t#é") for _ in range(r.randint(0, 80))) for _ in range(2000)]
    for t in texts:
        assert quality.statistics(t) == brute(t), repr(t)


def corpus(n=900):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(60, 200))]
        bad = i % 17 == 0
        if bad:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 9}", bad))
    return rows


def test_outliers_go_and_clean_texts_stay(spark):
    rows = corpus()
    extra = [(9000 + k, t, None, None, True) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(r[3], "x", r[0], r[1], r[2]) for r in rows + extra], "source string, x0 string, doc_id bigint, text string, lang string")
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    assert len(got) == len(rows) + len(extra)
    for i, t, _, _, bad in rows:
        assert got[i].kept is not bad
        assert not got[i].base_failed
    for i, t, *_ in extra:
        n, _, _, _, rep, _ = brute(t)
        assert got[i].base_failed is (n < 50 or 100 * rep > 50 * n)
        assert not (got[i].base_failed and got[i].kept)
    assert sorted(quality.judge(df.union(df)).groupBy("doc_id").count().select("count").distinct().collect()) == [(2,)]


def test_few_rows_and_no_rows(spark):
    few = spark.createDataFrame([(i, t, "en", "s") for i, t, *_ in corpus(20)], "doc_id bigint, text string, lang string, source string")
    assert all(x.kept for x in quality.judge(few).collect())
    assert quality.judge(few.limit(0)).collect() == []


def test_estimate_ignores_contamination(spark):
    r = np.random.default_rng(5)
    clean = r.normal([1, 2, 3, 1], [0.5, 1, 1.5, 2], (2000, 4))
    dirty = r.normal(12, 0.2, (400, 4))
    rows = [("l", "s", *map(float, x)) for x in np.vstack([clean, dirty])]
    got = quality.estimate(spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")).collect()
    assert {g.g.level for g in got} == {0, 1, 2}
    for g in got:
        assert np.allclose(g["mean"], [1, 2, 3, 1], atol=0.2)
        cov = np.linalg.inv(np.array(g.inverse).reshape(4, 4)) - np.diag(np.square(quality.FLOOR))
        assert np.allclose(np.sqrt(np.diag(cov)), [0.5, 1, 1.5, 2], rtol=0.12)


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3 and abs(quality.chi2_cdf(5.0, 6) - 0.4562) < 1e-3


def test_groups_beyond_the_broadcast_are_joined_with_salts(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = spark.createDataFrame([("l", f"s{i % 3}", *map(float, x)) for i, x in enumerate(r.normal(3, 1, (900, 4)))], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    want = {x.g: x for x in quality.estimate(rows).collect()}
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    got = {x.g: x for x in quality.estimate(rows).collect()}
    assert got.keys() == want.keys() and len(got) == 5
    assert all(np.allclose(got[g]["mean"], want[g]["mean"]) and got[g].rows == want[g].rows for g in got)


def test_the_start_of_least_determinant_wins(spark):
    """Four in ten rows lie apart, so far that mean and covariance of all rows lead nowhere; the estimate is that of the rest."""
    r = np.random.default_rng(7)
    rows = np.vstack([r.normal(0, 0.3, (1400, 4)), r.normal([6, 6, 0, 0], 0.1, (400, 4))])
    got = quality.estimate(spark.createDataFrame([("l", "s", *map(float, x)) for x in rows], "lang string, source string, x0 double, x1 double, x2 double, x3 double")).collect()
    assert all(np.allclose(g["mean"], 0, atol=0.05) for g in got)


def test_one_statistic_alone_rejects(spark):
    """A text that is usual but for its symbols, repeated lines, repeated words or length of words."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line(12) for _ in range(10))) for i in range(400)]
    same, three = line(12), line(3)
    planted = [
        " ".join(w + ("#" if k % 5 == 0 else "") for k, w in enumerate(line(120).split())),
        "\n".join([same] * 4 + [line(12) for _ in range(6)]),
        line(60) + f" {three}" * 15,
        " ".join(word() + word() + word() for _ in range(120)),
    ]
    df = spark.createDataFrame([*rows, *((1000 + k, t) for k, t in enumerate(planted))], "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    assert not any(got[1000 + k].base_failed or got[1000 + k].kept for k in range(len(planted)))
    assert sum(got[i].kept for i, _ in rows) >= 398
