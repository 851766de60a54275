import random

import pytest
from pyspark.sql import functions as F

from quire.functions import labels, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('"Hello," he said.', "“Hello,” he said."),
        ("'Tis the season", "’Tis the season"),
        ("the '90s and '45", "the ’90s and ’45"),
        ("don't Tom's", "don’t Tom’s"),
        ("he said 'yes'.", "he said ‘yes’."),
        ('He--"no"--left', "He--”no”--left"),
        ('He—"no"—left', "He—“no”—left"),
        ("“'Twas he", "“’Twas he"),
        ("rock 'n' roll", "rock ’n’ roll"),
        ("—'what?'", "—‘what?’"),
        ("été d'été", "été d’été"),
    ],
)
def test_curly_quotes(spark, given, want):
    assert one(spark, given, text.curly_quotes) == want


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.remove_notes, "a[*x\ny]b[c]", "ab[c]"),
        (text.remove_blank_page, "[Blank Page]", ""),
        (text.accent, "[=a][:O][.z][`e]['y][)U][c,]['N][=y]", "āÖżèýŬçǸ[=y]"),
        (text.unwrap_footnotes, "x[12] [a]", "x12 [a]"),
        (text.join_starred_hyphens, "some-*thing\nnext more", "some-\nthing next more"),
        (text.long_dashes, "a----b--c---d", "a⸺b—c—-d"),
        (text.trim_stars, " \n*a-*\n", "a-"),
        (text.trim_stars, "**a**", "*a*"),
        (text.straight_quotes, "‘a’ “b” ‚c‛ „d‟", "'a' \"b\" 'c' \"d\""),
        (text.double_hyphens, "a—b", "a--b"),
        (text.plain_text, None, ""),
        (text.short_revision, "", "latest"),
        (text.short_revision, "0123456789", "01234567"),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, given, f) == want


def test_chain_keeps_the_order_of_its_steps(spark):
    assert one(spark, '[*[12]]\r\n[Blank Page]* "a--b"[3]*', text.proof_text) == "]\n* “a—b”3"


@pytest.mark.parametrize(("given", "want"), [("a\nb\n", ["a", "b"]), ("", []), ("a\r\n\nb", ["a", "", "b"]), ("x", ["x"])])
def test_lines(spark, given, want):
    assert one(spark, given, text.split_lines) == want


def test_words_and_graphemes(spark):
    assert one(spark, "  a b \t c ", text.split_words) == ["a", "b", "c"]
    assert one(spark, "é👨‍👩‍👧a", text.graphemes) == ["é", "👨‍👩‍👧", "a"]


def test_labels(spark):
    df = spark.createDataFrame([(["Italic", "regular", " ITALICS", "small-caps"], {"a": "positive", "b": "unknown"})], "l array<string>, s map<string,string>")
    got = df.select(
        labels.canonical_labels(F.col("l"), {"italic": "italics"}),
        labels.missing_labels(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("s")),
        labels.is_complete(F.array(F.lit("a")), F.col("s"), F.lit("reviewed")),
        labels.scopes(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))),
    ).first()
    assert list(got) == [["italics", "small caps"], ["b", "c"], True, {"x": "whole", "y": "part"}]


def test_identifiers(spark):
    import uuid

    df = spark.createDataFrame([("page/1/é", "b" * 64, 3)], "t string, h string, n int")
    got = df.select(labels.uuid5(uuid.NAMESPACE_URL, F.col("t")), labels.is_sha256(F.col("h")), labels.content_id({"b": F.col("n"), "a": F.col("t")})).first()
    assert got[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "page/1/é"))
    assert got[1] and got[2] == labels.canonical_id({"a": "page/1/é", "b": 3})


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("'Never mind", "'Never mind"),
        ("'Enough, 'Emily said", "'Enough, 'Emily said"),
        ("'never mind, 'enough", "‘never mind, ‘enough"),
        ("'Tilda and 'tilda", "'Tilda and ‘tilda"),
        ("'Til then, 'til then", "’Til then, ’til then"),
        ("'Hello,' he said", "‘Hello,’ he said"),
        ("\"'Tis so,\" and \"'Never\"", "“’Tis so,” and “'Never”"),
        ("('tis) ('word') [\"x\"]", "('tis) (‘word’) [“x”]"),
        ("he—'twas—'Never— 'Never—'", "he—’twas—‘Never— ‘Never—’"),
        ("the '90s, '05 and —'90s", "the ’90s, ’05 and —‘90s"),
        ("‘tis ‘twas ‘other", "’tis ’twas ‘other"),
        ("James' dogs' don't", "James’ dogs’ don’t"),
        ("a,'b '' x", "a,'b ‘' x"),
        ("", ""),
    ],
)
def test_marks_before_words_like_elisions(spark, given, want):
    assert one(spark, given, text.curly_quotes) == want


def test_accents_in_one_pass_equal_replacement_of_each_code(spark):
    r = random.Random(3)
    codes = text.diacritic_codes()
    for _ in range(30):
        given = "".join(r.choice([*codes, "[", "]", "[[", "[=", "a", "\n", "[c", ",]"]) for _ in range(20))
        want = given
        for code, letter in codes.items():
            want = want.replace(code, letter)
        assert one(spark, given, text.accent) == want
