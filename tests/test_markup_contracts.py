import random

from quire.operators import contracts, markup


def test_tokens_cover_their_text():
    r = random.Random(2)
    parts = ["a", " ", "<i>", "</i>", "<sc>", "</b>", "[**n?]", "[**", "/*", "*/", "/#", "^{2}", "_{x}", "<x y>", "é", "\n", "]", "<"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        found = markup.lex(t)
        assert "".join(x["text"] for x in found) == t
        assert [x["start"] for x in found[1:]] == [x["end"] for x in found[:-1]]
        page = markup.parse(t)
        assert page["visible"] == "".join(x["visible"] for x in found)
        n = len(markup.GRAPHEME.findall(page["visible"]))
        assert all(0 <= s["start"] < s["end"] <= n for s in page["spans"])


def test_parse():
    page = markup.parse("A <i>b<b>c</b></i>[**d?] x^{2} <i></i>")
    assert page["visible"] == "A bc x2 "
    assert page["spans"] == [{"label": "bold", "start": 3, "end": 4}, {"label": "italics", "start": 2, "end": 4}]
    assert page["warnings"] == ["note_quarantine"] and not page["trainable"]
    assert markup.parse("plain <sc>Caps</sc>")["trainable"]
    assert markup.parse("</i>x")["warnings"] == ["mismatched_close_tag"]
    assert markup.parse("<i>x /* y #/")["warnings"] == ["crossed_block", "unclosed_tag"]
    assert markup.parse("a [**never closed")["warnings"] == ["unclosed_note"]
    assert markup.parse("<b>é👨‍👩‍👧</b>")["spans"] == [{"label": "bold", "start": 0, "end": 2}]


def test_tokens_and_pages_as_frames(spark):
    df = spark.createDataFrame([(1, "a <i>b</i>"), (2, None)], "k int, t string")
    assert [(x.k, x.kind, x.visible) for x in markup.tokens(df, "k", "t").orderBy("k", "pos").collect()] == [(1, "text", "a "), (1, "open_tag", ""), (1, "text", "b"), (1, "close_tag", "")]
    assert {x.k: x.visible for x in markup.pages(df, "k", "t").collect()} == {1: "a b", 2: ""}


def test_rules(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, h string")
    child = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 9, 0), (4, None, 2)], "id int, ref int, n int")
    assert [x.id for x in contracts.dangling(child, parent, {"ref": "id"}).orderBy("id").collect()] == [3, 4]
    assert [tuple(x) for x in contracts.repeated_keys(parent, ["id"]).collect()] == [(2, 2)]
    assert {x.ref for x in contracts.not_dense(child, ["ref"], "n").collect()} == {None}
    assert {x.ref for x in contracts.mixed(child, ["ref"], "n").collect()} == {1}
    got = contracts.verdict({"x": contracts.dangling(child, parent, {"ref": "id"}), "y": parent.limit(0)}).collect()
    assert {x.rule: x.n_broken for x in got} == {"x": 2, "y": 0}


def test_spans(spark):
    spans = spark.createDataFrame([(1, "i", 0, 2, 4), (1, "i", 2, 4, 4), (1, "b", 0, 1, 4), (1, "b", 2, 4, 4), (2, "i", 0, 5, 4)], "w int, label string, start int, end int, n int")
    assert {tuple(x) for x in contracts.whole_labels(spans, ["w"], "n").collect()} == {(1, "i"), (2, "i")}
    assert [x.w for x in contracts.bad_spans(spans, "n").collect()] == [2]
    points = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (3, 0)], "w int, at int")
    assert {(x.w, x.at): x.labels for x in contracts.labels_at(spans, points, "w").collect()} == {(1, 0): ["b", "i"], (1, 1): ["i"], (1, 3): ["b", "i"]}
