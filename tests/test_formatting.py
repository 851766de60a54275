import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import formatting

RULE_COMMENTS = "f is blackletter"
PARTS = ["a", " ", "<i>", "</i>", "<sc>", "</sc>", "</b>", "<g>", "</g>", "<f>", "</f>", "[**n?]", "[**", "[*", "/*", "*/", "/#", "#/", "^{2}", "^{}", "_x", "^", "<x y>", "</x>", "<x/>", "<", ">", "é", "é", "👨‍👩‍👧", "ẞ", "\n", "]", "}"]


def test_tokens_rebuild_their_source():
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 16)))
        raw, found = t.encode(), formatting.lex(t)
        assert "".join(x["text"] for x in found) == t
        assert all(raw[x["byte_start"] : x["byte_end"]].decode() == x["text"] == t[x["start"] : x["end"]] for x in found)
        assert all(not (x["kind"] == y["kind"] == "text") for x, y in zip(found, found[1:], strict=False))
        page = formatting.parse(t)
        assert page["visible"] == "".join(x["visible"] for x in found)
        seen = formatting.visible_graphemes(t, formatting.Scan(t).tokens)
        assert "".join(g for g, _ in seen) == page["visible"]
        assert all("".join(t[a:b] for a, b in runs) == g for g, runs in seen)
        assert all(0 <= s["start"] < s["end"] <= len(seen) for s in page["spans"])
        assert all(0 <= f["byte_start"] < f["byte_end"] <= len(raw) for f in page["flaws"])


# What each construct gives: text, kinds of tokens, visible text, codes of flaws.
CASES = [
    ("a<i>b</i>", "text open_tag text close_tag", "ab", []),
    ("[**x] [*y]", "note text", " [*y]", ["note_quarantine"]),
    ("a [**x <i>", "text unknown", "a ", ["note_quarantine", "unclosed_note"]),
    ("<x a>b<i>c</x>d", "unknown unknown unknown text", "<x a>b<i>c</x>d", ["unknown_construct"]),
    ("<x>b</i>", "unknown unknown", "<x>b</i>", ["unclosed_unknown_tag", "unknown_construct"]),
    ("<x/>b</y><i >c</i>", "unknown text unknown unknown unknown unknown", "<x/>b</y><i >c</i>", ["unknown_construct"] * 3),
    ("1 <b", "text unknown", "1 <b", ["invalid_construct"]),
    ("1 < 2 <> </>", "text", "1 < 2 <> </>", []),
    ("x^2_{n}^", "text superscript subscript unknown", "x2n^", ["invalid_construct"]),
    ("x^{} <i>", "text unknown", "x^{} <i>", ["invalid_construct"]),
    ("x^ _[", "text", "x^ _[", []),
    ("<g>a b</g> c", "open_tag text normalization text close_tag text", "ab c", ["letter_space_removed"]),
    ("<g><i>a b</g> c", "open_tag open_tag text normalization text close_tag normalization text", "abc", ["letter_space_removed"] * 2 + ["mismatched_close_tag"] + ["unclosed_tag"] * 2),
    ("/*a*//#b#/", "block_open text block_close block_open text block_close", "ab", []),
    ("/*a#/", "block_open text block_close", "a", ["crossed_block", "unclosed_block"]),
    ("a*/", "text block_close", "a", ["unmatched_block"]),
]


@pytest.mark.parametrize(("text", "kinds", "visible", "codes"), CASES)
def test_constructs(text, kinds, visible, codes):
    assert " ".join(x["kind"] for x in formatting.lex(text)) == kinds
    page = formatting.parse(text)
    assert (page["visible"], sorted(f["code"] for f in page["flaws"])) == (visible, codes)


def test_long_texts_take_linear_time():
    for piece in ("<x>", "<a b", "[**", "^{", "<i>", "</i>", "<g> ", "/*", "<x></x>", "< "):
        begun = time.perf_counter()
        formatting.parse(piece * 100_000)
        assert time.perf_counter() - begun < 10, piece


def made(spark, rows, **more):
    df = spark.createDataFrame(rows, "k int, project string, comments string, t string")
    return {r.k: r for r in formatting.records(df, "t", **more).collect()}


def test_all_warnings_and_verdicts(spark):
    texts = {
        "ambiguous_font_change": "<f>a</f>", "invalid_construct": "a^", "letter_space_removed": "<g>a b</g>", "mismatched_close_tag": "</i>", "note_quarantine": "[**a]",
        "small_caps_case_normalized": "<sc>Ab</sc>", "unapproved_underline": "<u>a</u>", "unclosed_note": "[**a", "unclosed_block": "/*", "unclosed_tag": "<i>a",
        "unclosed_unknown_tag": "<x>", "unknown_construct": "</x>", "unmatched_block": "#/", "crossed_block": "/*#/",
    }
    names = sorted(texts)
    found = made(spark, [(i, None, None, texts[n]) for i, n in enumerate(names)])
    seen = [found[i].page.warnings for i in range(len(names))]
    assert all(n in w and w == sorted(set(w)) for n, w in zip(names, seen, strict=True))
    assert {w for x in seen for w in x} == set(names) and len(names) == 14
    assert [found[i].page.trainable for i in range(len(names))] == [n in ("letter_space_removed", "small_caps_case_normalized") for n in names]


def test_styles_of_pages(spark):
    found = made(spark, [(1, None, None, "<i><b>word</b></i>, <sc>AéB</sc><b></b>x^{2}/#<i>y#/"), (2, None, None, None), (3, None, None, "")])
    page = found[1].page
    assert [(s.label, s.start, s.end) for s in page.spans] == [("bold", 0, 4), ("italic", 0, 4), ("small_caps", 6, 9), ("superscript", 10, 11)]
    assert [(x.grapheme, x.text) for x in page.lowered] == [(6, "a"), (8, "b")]
    assert page.contexts == ["display_block"] and [x.tag for x in page.unclosed] == ["i"]
    assert page.warnings == ["small_caps_case_normalized", "unclosed_tag"] and not page.trainable
    for k in (2, 3):
        assert (found[k].page.visible, found[k].page.spans, found[k].page.warnings, found[k].page.trainable) == ("", [], [], True)


def test_rules_bind_project_and_comments(spark):
    rules = spark.sql(f"SELECT 'p' project, upper(sha2('{RULE_COMMENTS}', 256)) comments_sha256, 'f' tag, 'font_blackletter' label, 'r1' rule_ref")
    text = "<f>a</f><u>b</u>"
    rows = [(1, "p", RULE_COMMENTS, text), (2, "p", RULE_COMMENTS + " ", text), (3, "q", RULE_COMMENTS, text), (4, None, None, text), (5, "p", RULE_COMMENTS, "<f>a"), (6, "p", RULE_COMMENTS, "<f>a</f>")]
    found = made(spark, [*rows, rows[0]], project="project", comments="comments", rules=rules)
    assert [(s.label, s.state, s.tier, s.rule_ref, s.warnings) for s in found[1].page.spans] == [("font_blackletter", "positive", "gold", "r1", []), ("underline", "unknown", "quarantine", None, ["unapproved_underline"])]
    for k in (2, 3, 4):
        assert [(s.label, s.state) for s in found[k].page.spans] == [("font_other_reviewed", "unknown"), ("underline", "unknown")]
        assert found[k].page.warnings == ["ambiguous_font_change", "unapproved_underline"]
    assert found[5].page.warnings == ["unclosed_tag"] and found[6].page.trainable


def test_bad_rules(spark):
    h = "a" * 64
    rules = spark.createDataFrame([("p", h, "f", "font_antiqua", "1"), ("p", h.upper(), "u", "underline", "2"), ("q", "x", "f", "font_antiqua", "3"), ("q", h, "u", "font_antiqua", "4"), ("q", h, "i", "italic", "5"), ("r", h, "u", "underline", "6"), ("r", h, "u", "underline", "7")], "project string, comments_sha256 string, tag string, label string, rule_ref string")
    got = sorted((r.project, r.tag, r.reason) for r in formatting.bad_rules(rules).collect())
    assert got == [("q", "f", "no hash"), ("q", "i", "label not allowed"), ("q", "u", "label not allowed"), ("r", "u", "repeated")]


def test_frames(spark):
    df = spark.createDataFrame([(1, "é<g>a ́b</g>", 7), (2, None, 8)], "k int, t string, visible int")
    got = [(r.k, r.visible, r.token.pos, r.token.kind, r.token.byte_start, r.token.byte_end) for r in formatting.tokens(df, "t").collect()]
    assert got == [(1, 7, 0, "text", 0, 2), (1, 7, 1, "open_tag", 2, 5), (1, 7, 2, "text", 5, 6), (1, 7, 3, "normalization", 6, 7), (1, 7, 4, "text", 7, 10), (1, 7, 5, "close_tag", 10, 14)]
    letters = formatting.graphemes(df, "t").select("grapheme.*").orderBy("pos").collect()
    assert [(r.pos, r.text, [(s.start, s.end) for s in r.slices]) for r in letters] == [(0, "é", [(0, 2)]), (1, "á", [(5, 6), (7, 9)]), (2, "b", [(9, 10)])]
    assert formatting.records(df.limit(0), "t").count() == 0
    with pytest.raises(ValueError, match="visible"):
        formatting.records(df, "t", into="visible")
    plan = formatting.records(df.where(F.col("k") == 1), "t")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["formatted_tokens", "formatted_spans", "formatted_pages"])
def test_odd_pages_equal_their_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as e

    texts = [None, "", "#*_<>", " ", "a in b die c of d.", "a in b"]
    rows = [(10 * i + k, t, s) for i, t in enumerate(texts) for k, s in enumerate([None, "", "src0", "src1", "src3", "src99"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = e.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(e.oracle_sql()[name])
    assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)
