from pyspark.sql import functions as F

from quire.operators import edits, layout, reading

REGION = "page int, pos int, type string, l double, t double, r double, b double, confidence double"
WORD = "page int, line_no int, word_no int, word string, l double, t double, r double, b double, conf double"


def words(spark, rows):
    return spark.createDataFrame(rows, WORD)


def line(page, no, y, texts, x=0.0, step=50.0, h=10.0):
    return [(page, no, i, w, float(x + step * i), float(y), float(x + step * i + 40), float(y + h), 0.5) for i, w in enumerate(texts)]


def test_tags_by_centre_and_confidence(spark):
    regions = spark.createDataFrame([(1, 0, "text", 0.0, 0.0, 100.0, 100.0, 0.9), (1, 1, "caption", 0.0, 0.0, 30.0, 30.0, 0.6), (1, 2, "figure", 0.0, 0.0, 100.0, 100.0, 0.4), (2, 0, "table", 0.0, 0.0, 9.0, 9.0, 0.9)], REGION)
    found = words(spark, line(1, 0, 5, ["a", "b"]) + line(2, 0, 50, ["c"]))
    keys = ["page", "line_no", "word_no"]
    got = {(x.page, x.word): x.tags for x in layout.tag_words(found, regions, "page", keys).collect()}
    assert got == {(1, "a"): ["caption", "text"], (1, "b"): ["text"], (2, "c"): []}
    left = layout.drop_words(found, regions, "page", keys, ["caption"], by_type={"caption": 0.5}).collect()
    assert sorted(x.word for x in left) == ["b", "c"]
    role = layout.dominant_role(layout.tag_words(found, regions, "page", keys), ["page", "line_no"]).collect()
    assert [(x.page, x.role, x.hits, x.pool) for x in role] == [(1, "caption", 1, 1)]


def test_reading_order_by_columns(spark):
    two = [(1, 0, "text", 60.0, 0.0, 100.0, 50.0, 1.0), (1, 1, "text", 0.0, 30.0, 50.0, 60.0, 1.0), (1, 2, "text", 0.0, 0.0, 45.0, 20.0, 1.0)]
    wide = [(2, 0, "text", 60.0, 20.0, 100.0, 50.0, 1.0), (2, 1, "text", 0.0, 30.0, 50.0, 60.0, 1.0), (2, 2, "header", 0.0, 0.0, 100.0, 10.0, 1.0)]
    got = layout.reading_order(spark.createDataFrame(two + wide, REGION), "page").orderBy("page", "reading").collect()
    assert [(x.page, x.pos) for x in got] == [(1, 2), (1, 1), (1, 0), (2, 2), (2, 0), (2, 1)]


def test_captions(spark):
    rows = [
        (1, 0, "figure", 0.0, 0.0, 100.0, 100.0, 1.0), (1, 1, "text", 0.0, 105.0, 100.0, 120.0, 1.0), (1, 2, "caption", 0.0, 150.0, 100.0, 160.0, 1.0),
        (1, 3, "figure", 0.0, 60.0, 100.0, 130.0, 1.0), (1, 4, "caption", 200.0, 105.0, 300.0, 120.0, 1.0), (2, 0, "figure", 0.0, 200.0, 50.0, 300.0, 1.0), (2, 1, "caption", 0.0, 180.0, 50.0, 195.0, 1.0),
    ]
    regions = spark.createDataFrame(rows, REGION)
    got = {(x.page, x.figure): (x.caption, x.gap) for x in layout.nearest_caption(regions, "page").collect()}
    assert got == {(1, 0): (2, 50), (1, 3): (2, 20)}
    assert {(x.page, x.figure, x.caption) for x in layout.claimed_captions(regions, "page").collect()} == {(1, 3, 2)}
    assert {(x.page, x.figure) for x in layout.nearest_caption(regions, "page", above=True).collect()} == {(1, 0), (1, 3), (2, 0)}


def test_side_notes(spark):
    body = [(1, i, 0, "w", 100.0, 20.0 * i, 400.0, 20.0 * i + 10, 0.5) for i in range(12)]
    notes = [(1, 20 + i, 0, "n", 450.0, 20.0 * i, 490.0, 20.0 * i + 6, 0.5) for i in range(5)]
    found = words(spark, body + notes)
    got = layout.margin_words(found, "page", F.lit(600.0)).collect()
    assert {(x.line_no, x.side) for x in got} == {(20 + i, "right") for i in range(5)}
    assert layout.margin_words(found, "page", F.lit(600.0), max_height=0.5).count() == 0
    assert layout.margin_words(found, "page", F.lit(600.0), max_height=0.7).count() == 5


def lines(spark, rows):
    return spark.createDataFrame(rows, "page int, n int, l double, t double, r double, b double, text string, n_words int")


def test_row_blocks_break_at_wide_gaps(spark):
    rows = [(1, i, 0.0, 12.0 * i + (40 if i >= 3 else 0), 100.0, 12.0 * i + 10 + (40 if i >= 3 else 0), "x y", 2) for i in range(6)]
    aside = [(2, 0, 0.0, 0.0, 50.0, 10.0, "a b", 2), (2, 1, 60.0, 60.0, 99.0, 70.0, "c d", 2), (2, 2, 60.0, 71.0, 99.0, 80.0, "e f", 2)]
    got = {(x.page, x.n): x.block for x in reading.row_blocks(lines(spark, rows + aside), "page", ["n"]).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): 1, (2, 0): 0, (2, 1): 0, (2, 2): 0}


def test_paragraph_rules(spark):
    rows = [
        (1, 0, 0.0, 0.0, 100.0, 10.0, "First line of it", 4), (1, 1, 0.0, 12.0, 60.0, 22.0, "ends short.", 2), (1, 2, 0.0, 24.0, 100.0, 34.0, "Second begins", 2),
        (1, 3, 0.0, 36.0, 100.0, 46.0, "and goes on", 3), (1, 4, 10.0, 48.0, 100.0, 58.0, "An indent", 2), (1, 5, 0.0, 60.0, 40.0, 70.0, "broken", 1), (1, 6, 0.0, 72.0, 100.0, 82.0, "lower case runs on", 4),
    ]
    got = {x.n: x.paragraph for x in reading.paragraphs(lines(spark, rows), "page", ["n"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}


def test_bands(spark):
    rows = [(1, 0, 0.0, 5.0, 90.0, 15.0, "HEAD", 1), (1, 1, 0.0, 100.0, 90.0, 110.0, "body", 1), (1, 2, 0.0, 112.0, 90.0, 122.0, "body", 1), (1, 3, 0.0, 480.0, 90.0, 490.0, "7", 1)]
    close = [(2, 0, 0.0, 5.0, 90.0, 15.0, "body", 1), (2, 1, 0.0, 17.0, 90.0, 27.0, "body", 1), (2, 2, 0.0, 500.0, 90.0, 510.0, "9", 1)]
    found = lines(spark, rows + close)
    metrics = found.groupBy("page").agg(F.median(F.col("b") - F.col("t")).alias("median_word_h"), F.max("b").alias("coord_h"))
    got = {(x.page, x.n): x.band for x in reading.bands(found, metrics, "page", ["n"]).collect()}
    assert got[1, 0] == "header" and got[1, 3] == "footer" and got[1, 1] == got[1, 2] == "body"
    assert got[2, 2] == "footer" and got[2, 1] == "body" and got[2, 0] == "body"


def test_columns(spark):
    rows = [(1, i, 500.0 * (i % 2), 20.0 * i, 500.0 * (i % 2) + 400, 20.0 * i + 10, "x", 1) for i in range(8)]
    one = [(2, i, 1.0 * i, 20.0 * i, 900.0, 20.0 * i + 10, "x", 1) for i in range(8)]
    got = reading.column_split(lines(spark, rows + one), "page", ["n"], F.lit(1000.0)).collect()
    assert [tuple(x) for x in got] == [(1, 250.0, 4, 4)]


def test_dropped_words_are_recovered(spark):
    before = words(spark, line(1, 0, 0, ["a", "a", " ", "b"]) + line(1, 1, 0, ["a"]))
    after = before.where("line_no = 0 and word_no > 0")
    assert [x.word for x in reading.dropped_words(before, after, "page").collect()] == ["a", "a"]
    back = reading.recover(after, before, "page")
    assert reading.dropped_words(before, back, "page").count() == 0
    assert back.where("recovered").count() == 2


def test_whole_pipeline_keeps_every_line(spark):
    rows = [(p, i, 0.0, 14.0 * i + 30 * (i // 4), 100.0, 14.0 * i + 30 * (i // 4) + 10, "some words here", 3) for p in range(3) for i in range(12)]
    got = reading.reading_order(lines(spark, rows), "page", ["n"]).collect()
    assert sorted((x.page, x.place) for x in got) == [(p, i) for p in range(3) for i in range(12)]
    assert all(x.n == x.place for x in got)


def test_edits(spark):
    found = words(spark, line(1, 0, 0, ["un", "der", "stand"]) + line(1, 1, 20, ["x", "y"]) + line(1, 2, 40, ["z"]))
    merged = edits.merge_words(found, ["page", "line_no"]).orderBy("line_no").collect()
    assert [(x.word, x.l, x.r) for x in merged] == [("understand", 0, 140), ("xy", 0, 90), ("z", 0, 40)]
    parts = edits.split_words(found.where("word = 'stand'"), F.lit(2)).orderBy("part").collect()
    assert [(x.word, x.l, x.r, x.conf) for x in parts] == [("st", 100, 116, None), ("and", 116, 140, None)]
    assert edits.split_words(found.where("word = 'z'"), F.lit(3)).first().word == "z"
    folded = edits.merge_lines(found, "page", F.col("line_no") != 1).orderBy("line_no", "word_no").collect()
    assert [(x.line_no, x.word_no, x.word) for x in folded] == [(0, 0, "un"), (0, 1, "der"), (0, 2, "stand"), (0, 3, "z"), (1, 0, "x"), (1, 1, "y")]
    cut = edits.split_line(found, "page", F.when(F.col("line_no") == 0, 0)).orderBy("line_no", "word_no").collect()
    assert [(x.line_no, x.word) for x in cut] == [(0, "un"), (1, "der"), (1, "stand"), (2, "x"), (2, "y"), (3, "z")]
    near = edits.closest_line(found.groupBy("page", "line_no").agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")), "page", F.lit(0.0), F.lit(25.0)).collect()
    assert [tuple(x) for x in near] == [(1, 1)]
