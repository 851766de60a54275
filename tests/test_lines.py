import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import images, lines, matching

WORD = "page int, line_no int, word_no int, word string, l double, t double, r double, b double"


@pytest.mark.parametrize(("text", "want"), [("II1s", True), ("KMV", True), ("TEor", True), ("Title", False), ("UPPER", False), ("lower", False), ("abc def", False), ("ab", False), ("1234", False), ("éàù", True)])
def test_gibberish(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(lines.is_gibberish(F.col("t"))).first()[0] is want


def test_weak_lines(spark):
    rows = [("a", 1, 1, 10.0), ("I", 1, 1, 30.0), ("- .", 2, 1, 10.0), ("word", 1, 4, 10.0), ("a b c", 3, 1, 10.0), ("--", 1, 2, 30.0), ("", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "t string, n int, longest int, h double")
    got = [x[0] for x in df.select(lines.is_weak(F.col("t"), F.col("n"), F.col("longest"), F.col("h"), F.lit(12.0))).collect()]
    assert got == [True, False, True, False, False, True, False]
    assert df.where("t = 'I'").select(lines.is_weak(F.col("t"), F.col("n"), F.col("longest"), F.col("h"), F.lit(12.0), protect=False)).first()[0]
    assert [x[0] for x in df.select(lines.is_punctuation(F.col("t"))).collect()] == [False, False, False, False, False, True, False]


def test_noise_clusters_go(spark):
    rows = [(1, i, 20.0 * i, 20.0 * i + 10, i in (2, 3, 4, 8)) for i in range(10)]
    df = spark.createDataFrame(rows, "page int, n int, t double, b double, weak boolean")
    assert sorted(x.n for x in lines.noise_clusters(df, "page", ["n"], F.col("weak"), F.lit(10.0)).collect()) == [0, 1, 5, 6, 7, 8, 9]


def row(y, heights, texts, gap_after, page=1, line=0):
    x, out = 0.0, []
    for i, (h, w) in enumerate(zip(heights, texts, strict=True)):
        out.append((page, line, i, w, x, y, x + 30, y + h))
        x += 35 + (60 if i == gap_after else 0)
    return out


def test_mixed_lines(spark):
    rows = row(0.0, [8.0, 8.0, 12.0, 12.0], ["Fig.", "one,", "and", "so"], 1)
    rows += row(0.0, [8.0, 8.0, 12.0, 12.0], ["Fig.", "one", "And", "so"], 1, line=1)
    rows += row(0.0, [10.0] * 4, ["a", "b,", "c", "d"], 1, line=2)
    rows += row(0.0, [8.0, 12.0, 12.0, 12.0], ["a-", "b", "c", "d"], 0, line=3)
    df = spark.createDataFrame(rows, WORD)
    got = lines.split_mixed(df, "page", ["line_no"], F.lit(1000.0)).collect()
    assert [(x.line_no, x.last_left) for x in got] == [(0, 1)]
    near = lines.split_mixed(df, "page", ["line_no"], F.lit(1000.0), F.lit(100.0)).collect()
    assert sorted((x.line_no, x.last_left) for x in near) == [(0, 1), (1, 1)]


def test_fragments_rejoin(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 10.0), (1, 1, 104.0, 1.0, 190.0, 11.0), (1, 2, 195.0, 0.0, 300.0, 10.0), (1, 3, 0.0, 20.0, 300.0, 30.0), (1, 4, 305.0, 20.0, 330.0, 60.0)]
    df = spark.createDataFrame(rows, "page int, line_no int, l double, t double, r double, b double")
    assert {x.line_no: x.joined for x in lines.rejoin(df, "page").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_grown_blocks_equal_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        x, y = r.uniform(0, 400), r.uniform(0, 400)
        rows.append((1, 0, i, "w", x, y, x + 20, y + 8))
    got = {x.word_no: x.block for x in lines.grown_blocks(spark.createDataFrame(rows, WORD), "page", ["line_no", "word_no"], 12.0, 9.0).collect()}
    near = lambda a, b: max(a[4], b[4]) - min(a[6], b[6]) <= 12 and max(a[5], b[5]) - min(a[7], b[7]) <= 9
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if near(rows[i], rows[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(got.values())) == len(set(root))
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(60) for j in range(60))


def test_floats(spark):
    rows = [(1, i, 0.0, 20.0 * i, 500.0, 20.0 * i + 10) for i in (0, 1, 8, 9, 10, 11, 12)]
    rows += [(1, 20 + i, 0.0, 20.0 * i + 40, 200.0, 20.0 * i + 50) for i in range(3)] + [(1, 30 + i, 300.0, 20.0 * i + 40, 500.0, 20.0 * i + 50) for i in range(3)]
    df = spark.createDataFrame(rows, "page int, n int, l double, t double, r double, b double")
    got = {x.n: x.flow for x in lines.floated(df, "page", ["n"], F.lit(500.0)).collect()}
    assert got == {0: "pre", 1: "pre", 8: "post", 9: "post", 10: "post", 11: "post", 12: "post", 20: "left", 21: "left", 22: "left", 30: "right", 31: "right", 32: "right"}


def test_variants_and_combined_words():
    assert matching.best_variant("standing here", "we under-", "standing here") == (100, "standing here")
    assert matching.best_variant("understanding here", "we under-", "standing here") == (100, "understanding here")
    assert matching.best_variant("some-", "", "something")[1] == "some-"
    assert matching.combined_words(["un", "der", "stand", "x"], ["understand", "x"]) == [(0, 3, 0)]
    view, source, log = matching.comparison_view("É­’x")
    assert (view, source) == (["é", "'", "x"], [0, 2, 3])
    assert log == [(0, "casefolded"), (1, "soft_hyphen_removed"), (2, "punctuation_folded")]
    assert matching.comparison_view("é")[0] == ["é"]


def test_truth_is_projected(spark):
    source = spark.createDataFrame([(1, 0, "Under"), (1, 1, "stand"), (1, 2, "me")], "doc int, pos int, text string")
    target = spark.createDataFrame([(1, 0, "understand"), (1, 1, "me")], "doc int, pos int, text string")
    got = matching.project_relations(source, matching.match_documents(source, target, "doc"), target, "doc").orderBy("pos").collect()
    assert [(x.truth, x.relation) for x in got] == [("understand", "sources_to_one"), ("understand", "sources_to_one"), ("me", "one_to_one")]


def test_page_correction():
    x = np.full((80, 120), 255, np.uint8)
    for k in range(10, 70, 12):
        for j in range(120):
            y = k + round(6 * (j / 120) ** 2)
            x[y : y + 3, j] = 0
    assert images.curvature(x) > 0.1
    flat = images.straighten(x)
    assert images.curvature(flat) < images.curvature(x) / 2
    assert abs(images.correct(x)["skew"]) < 5
    assert images.curvature(np.full((5, 5), 255, np.uint8)) == 0


def test_light_and_contrast():
    g = np.tile(np.linspace(80, 200, 64).astype(np.uint8), (64, 1))
    assert images.flatten(g, 9)[:, 5:-5].std() < 15
    assert images.stretch(g).max() == 255 and images.stretch(g).min() == 0
    assert images.equalize(g).shape == g.shape and images.equalize(g).std() > 0
    assert images.on_canvas(g, 100, 40).shape == (100, 40)
    assert abs(images.smooth(g, 2.0).astype(int) - g).max() < 12 and (images.median_filter(g) == g)[:, 1:-1].all()
    rgb = np.zeros((4, 4, 3), np.uint8)
    rgb[:2, :, 1] = 250
    assert (images.best_channel(rgb) == rgb[..., 1]).all()
    page = np.full((300, 300), 255, np.uint8)
    page[50:55, 50:55] = 0
    page[100:160, 100:160] = 0
    assert images.boxes_of_parts(page) == [(50, 50, 55, 55), (100, 100, 160, 160)]
    assert (images.drop_small_parts(page)[100:160, 100:160] == 0).all() and (images.drop_small_parts(page)[50:55, 50:55] == 255).all()
