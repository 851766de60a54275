from pyspark.sql import functions as F

from quire.functions import labels
from quire.operators import continuations, layout, matching, reading


def test_even_gaps_and_lone_gaps(spark):
    rows = [(1, i, 0.0, 20.0 * i, 50.0, 20.0 * i + 10) for i in range(4)] + [(2, i, 0.0, t, 50.0, t + 10) for i, t in enumerate((0.0, 12.0, 90.0))] + [(3, 0, 0.0, 0.0, 5.0, 9.0), (3, 1, 0.0, 20.0, 5.0, 30.0), (4, 0, 0.0, 0.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, line_no int, l double, t double, r double, b double")
    got = {x.page: (x.n_gaps, x.consistent) for x in reading.gaps_consistent(df, "page", ["line_no"]).collect()}
    assert got == {1: (3, True), 2: (2, False), 3: (1, False)}


def test_blocks_within_earlier_ones_go(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 2, "b"), (1, 2, "c"), (1, 3, "a"), (1, 3, "c"), (2, 1, "b")]
    df = spark.createDataFrame(rows, "page int, block int, word string")
    assert sorted(tuple(x) for x in reading.uncovered_blocks(df, "page", "block", ["word"]).collect()) == [(1, 0), (1, 2), (2, 1)]


def test_indent_of_body_paragraphs(spark):
    rows = [(1, p, i, 0.1 + (0.04 if i == 0 and p < 3 else 0.0)) for p in range(4) for i in range(3)] + [(1, 9, 0, 0.5), (1, 9, 1, 0.45), (2, 0, 0, 0.2)]
    df = spark.createDataFrame(rows, "page int, paragraph int, line_no int, l double")
    got = {x.page: (x.body_left, round(x.standard_indent, 9)) for x in reading.indent_signature(df, "page", "paragraph", ["line_no"]).collect()}
    assert got == {1: (0.1, 0.04), 2: (0.2, 0.03)}


def test_blocks_without_words_stay(spark):
    rows = [(1, 0, "a"), (1, 1, None), (1, 2, "a"), (1, 3, None), (2, 0, None)]
    df = spark.createDataFrame(rows, "page int, block int, word string")
    assert sorted(tuple(x) for x in reading.uncovered_blocks(df, "page", "block", ["word"]).collect()) == [(1, 0), (1, 1), (1, 3), (2, 0)]


def test_skipped_lines_have_no_indent(spark):
    verse = [(1, 20 + p, i, 0.02, "poetry") for p in range(9) for i in range(2)] + [(3, 0, 0, 0.3, "sidenote")]
    rows = [(1, p, i, 0.1 + (0.04 if i == 0 else 0.0), None if p else "body") for p in range(4) for i in range(3)] + verse
    df = spark.createDataFrame(rows, "page int, paragraph int, line_no int, l double, role string")
    got = {x.page: (x.body_left, round(x.standard_indent, 9)) for x in reading.indent_signature(df, "page", "paragraph", ["line_no"], F.col("role") != "body").collect()}
    assert got == {1: (0.1, 0.04)}
    assert {x.page: x.body_left for x in reading.indent_signature(df, "page", "paragraph", ["line_no"]).collect()} == {1: 0.02, 3: 0.3}


def test_caps_by_the_lexicon(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("Studies", "now", "know", "cat", "hat", "Once", "once", None, "")], "word string")
    words = spark.createDataFrame([(w,) for w in ("TUDIES,", "now", "at", "nce", "zzz", "", None)], "word string")
    got = {x.word: x.cap for x in reading.cap_letters(words, lexicon).collect()}
    assert got == {"TUDIES,": "S", "now": "K", "at": None, "nce": "O", "zzz": None, "": None, None: None}


def test_ordinals_count_within_one_boundary(spark):
    rows = [(1, 1, i, "p1", 0, n, n, w) for i, (n, w) in enumerate([(0, "a*b"), (0, "c*d"), (0, "e-*"), (1, "f"), (1, "g*h")])]
    tokens = spark.createDataFrame(rows, "doc int, round int, token_index int, page_id string, page_index int, line_id int, line_index int, text string")
    got = continuations.ordinals(continuations.edges(tokens, "doc"), "doc").orderBy("token_index").collect()
    assert [(x.token_index, x.boundary, x.ordinal) for x in got] == [(0, "same_line", 0), (1, "same_line", 1), (2, "line", 0), (4, "same_line", 0)]
    assert [(x.left_line_id, x.right_line_id) for x in got] == [(0, 0), (0, 0), (0, 1), (1, 1)]


def test_soft_wraps(spark):
    rows = [("they were op", "they were opposed", True), ("were op-", "were opposed", False), ("o", "opposed", False), ("were Op.", "were opposed,", True), ("opposed", "opposed", False), ("", "x", False), (None, "x", False), ("of", "opposed", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(x.got == x.want for x in df.withColumn("got", matching.soft_wrap(F.col("a"), F.col("b"))).collect())


def test_truth_only_of_words_with_text(spark):
    rows = [(1, 0, 0, "a", "A"), (1, 0, 1, "", "lost"), (1, 0, 2, "c", "C"), (1, 1, 0, "", "gone"), (1, 2, 0, "d", None), (1, 2, 1, "e", "E")]
    df = spark.createDataFrame(rows, "page int, line_no int, word_no int, word string, truth string")
    assert [tuple(x) for x in matching.truth_of_found(df, "page").collect()] == [(1, "A C\nE")]


def test_letter_spaces_small_caps_and_ligatures(spark):
    rows = [("w o r d", 0, 7, "word"), ("w o r d", 0, 6, None), ("w  or", 0, 5, None), ("a b c", 2, 5, "bc"), ("a b", 0, 9, None), ("ab", 0, 1, None), (" a ", 0, 3, None), ("a b", 2, 1, None)]
    df = spark.createDataFrame(rows, "x string, a int, b int, want string")
    got = df.withColumn("got", F.array_join(labels.letter_spaced(F.split("x", ""), F.col("a"), F.col("b")), "")).collect()
    assert [x.got for x in got] == [x.want for x in got]
    spans = spark.createDataFrame([([("small_caps", "positive", 1, 3), ("small_caps", "unknown", 0, 1), ("italics", "positive", 0, 2), ("small_caps", "positive", 2, 9)],)], "s array<struct<label:string,state:string,start:int,end:int>>")
    assert [tuple(x) for x in spans.select(labels.small_caps_ranges(F.col("s"), F.lit(5)).alias("r")).first().r] == [(1, 3)]
    kinds = spark.createDataFrame([(x,) for x in ("fi", "FI", "long_s_t", "LONG_S_T", "mystery")], "k string")
    assert [x[0] for x in kinds.select(labels.ligature_kind(F.col("k"))).collect()] == ["FI", "FI", "LONG_ST", "LONG_ST", "mystery"]


def test_tails_of_captions(spark):
    wide = [(1, i, 0.0, 200.0 + 20 * i, 500.0, 210.0 + 20 * i) for i in range(10, 20)]
    page = [(1, 0, 50.0, 100.0, 450.0, 110.0), (1, 1, 60.0, 112.0, 200.0, 122.0), *wide]
    going_on = [(2, 0, 50.0, 100.0, 450.0, 110.0), (2, 1, 60.0, 112.0, 200.0, 122.0), (2, 2, 60.0, 124.0, 200.0, 134.0), (2, 3, 60.0, 136.0, 200.0, 146.0), *[(2, *x[1:]) for x in wide]]
    without = [(3, 1, 60.0, 112.0, 200.0, 122.0)]
    df = spark.createDataFrame(page + going_on + without, "page int, line_no int, l double, t double, r double, b double")
    got = layout.caption_tails(df, "page", ["line_no"], F.col("line_no") == 0, F.lit(1000.0)).select("page", "line_no").collect()
    assert [tuple(x) for x in got] == [(1, 1)]
