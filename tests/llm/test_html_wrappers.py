import json
import random

from quire.llm import html_wrappers as hw


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def semantic(r, n):
    """(html, main text) with everything that is not main text around it."""
    title, paras = words(r, 6), [words(r, r.randint(5, 60)) for _ in range(n)]
    body = "".join(f"<p>{p}" + ("</p>" if r.random() < 0.7 else "") for p in paras)
    page = f"""<!doctype html><html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body class="home search">
<header><div class="logo">site</div></header><nav><ul><li><a href="/a">one<li><a href="/b">two</ul></nav><div id="cookie-notice">we use cookies</div>
<div class="ad">{words(r, 8)}</div><aside class="sidebar"><p>{words(r, 9)}</p></aside>
<article><h1>{title} &amp; more</h1>{body}<div class="share">tell all</div></article>
<form action="/s"><label>search</label><input name=q></form><section class="comments"><p>{words(r, 12)}</p></section>
<footer>&copy; {words(r, 2)}</footer>""" + ("</body></html>" if r.random() < 0.5 else "")
    return page, "\n\n".join([f"{title} & more", *paras])


def plain(r, n):
    """Nothing but divs: the constant parts are known by being the same on every page."""
    paras = [words(r, r.randint(8, 60)) for _ in range(n)]
    page = "<div class=top0>all of our pages say so</div><div class=mid>" + "".join(f"<div class=row>{p}</div>" for p in paras) + "</div><div class=end>the last words of this place</div>"
    return page, "\n\n".join(paras)


def test_main_text_of_hosts(spark):
    r = random.Random(1)
    rows = [(i, f"http://h{i % 5}.example/x?{i}", *(semantic if i % 5 < 3 else plain)(r, r.randint(1, 9))) for i in range(80)]
    odd = [(100, None, None), (101, "x", ""), (102, "http://one.example/", "<p>only &lt;text&#33;<br>two\n three"), (103, "http://two.example", "<div><p>never closed <a href='x'"), (104, "http://h0.example", "<<<>>")]
    df = spark.createDataFrame([("w", h, i, "t", u) for i, u, h, _ in rows] + [("w", h, i, "t", u) for i, u, h in odd], "wrapper string, html string, page_id bigint, text string, url string")
    got = {x.page_id: x for x in hw.main_texts(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, u, _, want in rows:
        assert (got[i].url, got[i].text) == (u, want)
    assert got[100].text == got[101].text == ""
    assert got[102].text == "only <text! two three"
    assert got[103].text == "never closed"
    assert hw.main_texts(df.limit(0)).collect() == []


def test_wrappers_do_not_depend_on_the_order():
    r = random.Random(2)
    pages = [hw.page_wrapper(semantic(r, r.randint(0, 5))[0]) for _ in range(12)]

    def fold(nodes):
        out = nodes[0]
        for n in nodes[1:]:
            out = hw.merge(out, n)
        return out

    a, b = fold(pages), hw.merge(fold(pages[6:]), fold(pages[:6]))
    assert hw.Keep(a).slots == hw.Keep(b).slots and hw.Keep(a).test is hw.Keep(b).test
    assert a.pages == b.pages == 12
    assert json.loads(json.dumps(a.pack())) == hw.Node.unpack(a.pack()).pack()


def test_mismatches_become_optional_and_repeated():
    a = hw.page_wrapper("<ul><li>x<li>y</ul><p>one</p>")
    b = hw.page_wrapper("<ul><li>x</ul><h2>t</h2><p>two</p>")
    both = hw.merge(a, b)
    assert both.expression("page") == "<page> <ul> (<li> # </>)+ </> (<h2> # </>)? <p> # </> </>"
    assert both.inner["p"].inner["#"].constant is False
    assert hw.page_wrapper("<div><p>a</p><h2>b</h2><p>c</p></div>").inner["div"].mixed


def test_kinds_of_token_are_bounded():
    many = "".join(f"<div class={'x' * (i % 70)}{'y' * (i // 70)}>t{i}</div>" for i in range(400))
    node = hw.page_wrapper(many)
    assert len(node.inner) <= hw.MAX_TOKENS + 1
    assert len(hw.merge(node, hw.page_wrapper(many.replace("x", "z"))).inner) <= hw.MAX_TOKENS + 1


def folded(pages):
    node = None
    for page in pages:
        own = hw.page_wrapper(page)
        node = own if node is None else hw.merge(node, own)
    return node


def test_text_beyond_the_bound_is_kept():
    """Every heading, article and section has its own id, and what comes after them keeps its slot."""
    r = random.Random(4)
    slug = lambda: "-".join("".join(r.choice("bcdfghjklm") for _ in range(6)) for _ in range(3))
    pages, want = [], []
    for _ in range(150):
        title, heads, paras, last = words(r, 5), [words(r, 4) for _ in range(3)], [words(r, 20) for _ in range(3)], words(r, 9)
        body = "".join(f'<h2 id="{slug()}">{h}</h2><section id="{slug()}"><p>{p}</p></section>' for h, p in zip(heads, paras, strict=True))
        pages.append(f'<body><article id="{slug()}"><h1>{title}</h1>{body}<p>{last}</p><div class="share" id="{slug()}">tell all</div></article><div id="{slug()}">elsewhere</div></body>')
        want.append("\n\n".join([title, *(x for h, p in zip(heads, paras, strict=True) for x in (h, p)), last]))
    for wrapper in (folded(pages), hw.merge(folded(pages[75:]), folded(pages[:75]))):
        keep = hw.Keep(hw.Node.unpack(json.loads(json.dumps(wrapper.pack()))))
        assert [hw.main_text(p, keep) for p in pages] == want


def test_text_beyond_the_bound_of_one_page(spark):
    r = random.Random(6)
    heads = [f"t{i} {words(r, 3)}" for i in range(400)]
    page = "<body><article>" + "".join(f'<h2 id="{"x" * (i % 70)}y{"z" * (i // 70)}">{h}</h2>' for i, h in enumerate(heads)) + "<p>the last</p>own words</article></body>"
    df = spark.createDataFrame([(1, "http://a.example/", page), (2, "http://a.example/", page)], "page_id long, url string, html string")
    assert [x.text for x in hw.main_texts(df).collect()] == ["\n\n".join([*heads, "the last", "own words"])] * 2


def test_linked_text_of_an_article_is_kept():
    r = random.Random(7)
    pages, want = [], []
    for i in range(6):
        title, para, plain_item = words(r, 4), words(r, 30), words(r, 5)
        items = [words(r, 6) for _ in range(5)]
        listed = "".join(f'<li><a href="/r">{x}</a></li>' for x in items)
        pages.append(f'<body><nav><a href="/">home</a></nav><article><h1><a href="/{i}">{title}</a></h1><p>{para}</p><ul>{listed}<li>{plain_item}</li></ul></article></body>')
        want.append("\n\n".join([title, para, *items, plain_item]))
    keep = hw.Keep(folded(pages))
    assert [hw.main_text(p, keep) for p in pages] == want


def test_copies_of_one_page_keep_their_text():
    page = "<body><div class=top0>all words</div><div class=row>the only page of this host</div></body>"
    assert hw.main_text(page, hw.Keep(folded([page] * 5))) == "all words\n\nthe only page of this host"
    other = "<body><div class=top0>other words</div><div class=mid>a second page</div></body>"
    keep = hw.Keep(folded([page] * 5 + [other] * 4))
    assert [hw.main_text(p, keep) for p in (page, other)] == ["all words\n\nthe only page of this host", "other words\n\na second page"]


def unnamed(r, n):
    """No name tells the article; the boxes around it change on every page, as long as an article's paragraph."""
    paras = [words(r, r.randint(8, 40)) for _ in range(n)]
    body = "".join(f"<p>{p}</p>" for p in paras)
    page = f'<div class=k1><p>all of our pages say so</p><div class=k2><p>{words(r, 12)}</p></div><div class=k3><div class=k4>{body}</div></div><div class=k5>{words(r, 9)}</div></div><div class=k6>the last words of this place, as ever</div>'
    return page, "\n\n".join(paras)


def test_the_wrapper_decides(spark):
    """A page of one short paragraph can't tell its article from the boxes around it; the wrapper of its host can."""
    r = random.Random(9)
    rows = [unnamed(r, n) for n in (1, 6, 9, 1, 7, 5, 8, 1)]
    df = spark.createDataFrame([(i, "http://a.example/", p) for i, (p, _) in enumerate(rows)], "page_id long, url string, html string")
    got = [x.text for x in hw.main_texts(df).orderBy("page_id").collect()]
    assert got == [want for _, want in rows]
    alone = [hw.main_text(p, hw.Keep(hw.page_wrapper(p))) for p, _ in rows]
    assert sum(a != b for a, b in zip(alone, got, strict=True)) >= 2


def test_what_all_pages_have_is_found_by_alignment():
    """Without the alignment of pages (every page its own wrapper), parts of the template stay."""
    r = random.Random(10)
    always = words(r, 50)
    rows = [(f"<div class=k1>{always}</div><div class=k2><div class=k3>{text}</div></div>", text) for text in (words(r, 9) for _ in range(5))]
    keep = hw.Keep(folded([p for p, _ in rows]))
    for p, want in rows:
        assert hw.main_text(p, keep) == want
        assert always in hw.main_text(p, hw.Keep(hw.page_wrapper(p)))


def test_a_host_of_two_templates(spark):
    r = random.Random(11)
    rows = []
    for i in range(12):
        page, want = semantic(r, 4) if i % 2 else plain(r, 5)
        rows.append((i, page, want))
    df = spark.createDataFrame([(i, "https://h.example/", p) for i, p, _ in rows], "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x.text for x in hw.main_texts(df).collect()}
    assert got == {i: want for i, _, want in rows}


def test_a_name_alone_does_not_decide():
    r = random.Random(12)
    pages, want = [], []
    for _ in range(5):
        title, text, note = words(r, 4), words(r, 40), words(r, 6)
        pages.append(f'<body><h1>{title}</h1><div class="story-side"><p>{text}</p></div><div class="ad">{note}</div></body>')
        want.append(f"{title}\n\n{text}")
    keep = hw.Keep(folded(pages))
    assert [hw.main_text(p, keep) for p in pages] == want
    assert hw.main_text('<div class="story-side"><p>kept words</p></div>', hw.Keep(hw.page_wrapper('<div class="story-side"><p>kept words</p></div>'))) == "kept words"
    long = '<article><p>short words</p></article><section class="comments">' + "<p>a reader says many words here</p>" * 40 + "</section>"
    assert hw.main_text(long, hw.Keep(hw.page_wrapper(long))) == "short words"


def test_long_pages_and_repeated_rows(spark):
    r = random.Random(13)
    paras = [words(r, 30) for _ in range(4000)]
    page = "<nav>x</nav><article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article>"
    df = spark.createDataFrame([(1, "http://a.example", page), (1, "http://a.example", page)], "page_id long, url string, html string")
    assert [x.text for x in hw.main_texts(df).collect()] == ["\n\n".join(paras)] * 2


def test_more_templates_than_the_bound_lose_nothing():
    r = random.Random(14)
    pages = []
    for k in range(hw.TEMPLATES + 6):
        text = words(r, 12)
        pages.append((f"<div class={'q' * (k + 1)}><section class={'z' * (k + 1)}><p>{text}</p><p>{text}</p></section></div>", f"{text}\n\n{text}"))
    all_of = []
    for p, _ in pages:
        all_of = hw.join_templates(all_of, [hw.page_wrapper(p)])
    assert len(all_of) <= hw.TEMPLATES
    known = hw.Templates(hw.unpack_all(hw.pack_all(all_of)))
    assert [hw.main_text(p, known.of(p)) for p, _ in pages[: hw.TEMPLATES]] == [w for _, w in pages[: hw.TEMPLATES]]
