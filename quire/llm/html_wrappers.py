"""Main text of web pages by wrappers inferred per host, in the way of union-free regular expressions.

A page is read into nested token streams: elements that structure a page (keyed by tag and class or id), and the text
blocks between them.  A wrapper is such a stream with, at each element, an order of inner tokens, some optional and some
repeated, and a slot for each text.  A page's own stream is folded first: equal neighbours become one repeated group;
tokens that come again further on make their parent's content a repeated group of optional parts.  Then wrapper and
page are aligned (longest common subsequence of inner tokens, at every level): what only one side has becomes optional,
text against text a slot.  Slots count pages, characters, characters in links, and whether their text ever changes.

A host may have several templates.  A page is aligned with the wrapper that has slots for most of its text, or begins a
new one if that is less than ALIKE; beyond TEMPLATES wrappers it joins the most alike.  Merging wrappers is the same
alignment, so wrappers are inferred in parts: one list for each task and host, merged in two levels by salted host; pages
never meet in one task.  A wrapper's size is bounded by MAX_TOKENS kinds of token at a level: those on most pages stay,
further kinds share one token for articles, one for menus and the like, and so on.

The wrapper tells which slots are main text.  Slots whose text is the same on CONSTANT_PAGES different pages belong to the
template; slots that change, in repeated or optional parts, hold what pages say.  Parts for menus, footers, forms and the
like are left out; a part that only its class name calls so stays if it holds most of the changing prose.  If an article
or main element holds a quarter of the rest, that is the main part, else an element of such a name; else the way
down from the root is followed as long as one element holds DOMINANT of the changing prose, and a heading before that
element belongs to it.  Without an article, slots that are mostly links, or constant, go.

Each page is then read again and each block looked up in the wrapper that fits the page.  A main part that only a name or
its prose tells loses its linked list items and table cells, which may be menus.  A block whose own token is not in the
wrapper is judged by the keys of its elements and its links alone, so no text is lost to the bound.

Null or empty html: empty text.  Null or odd urls: one host (empty).  Markup that isn't closed, or stops short, is read as
far as it goes.  Pages of any length are read whole.  Repeated rows get equal results.  Other columns are ignored.  No rows:
no rows.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SALTS = 32
MAX_TOKENS = 200
CONSTANT_PAGES = 3
LINK_SHARE = 0.5
ALIKE = 0.5
TEMPLATES = 16
DOMINANT = 0.6
#: Wrappers up to this many bytes in all are sent to the tasks; more are joined by host.
BROADCAST_BYTES = 64 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<(?![A-Za-z/!?]))", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option button audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = frozenset("article aside body blockquote div fieldset footer form header main nav ol section table td ul dl figure".split())
OFF_TAGS = frozenset("nav footer aside form menu dialog".split())
OFF_NAMES = re.compile(r"(?:^|[\s_-])(nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|ad|ads|adv|advert|advertisement|banner|sponsor(?:ed)?|promo|promotion|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|respond|replies|disqus|pagination|pager|copyright|complementary|contentinfo|alert)(?:$|[\s_-])", re.IGNORECASE)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|maincontent|post|entry|story|content|body|text)(?:$|[\s_-])", re.IGNORECASE)


COMMENT_NAMES = frozenset("comment comments commentlist respond replies disqus".split())
#: Tokens that kinds beyond the bound share: parts that are off, articles, main elements, other main parts, the rest.
SPARE = ("nav.*", "article.*", "main.*", "section.main *", "*")
KINDS = MAX_TOKENS - len(SPARE)


class Node:
    """A token of a wrapper: inner holds its inner tokens by key, in order; "#" is the text slot."""

    __slots__ = ("chars", "codes", "constant", "inner", "links", "mixed", "optional", "pages", "repeated", "text")

    def __init__(self):
        self.inner: dict[str, Node] = {}
        self.optional = self.repeated = self.mixed = False
        self.pages, self.chars, self.links, self.text, self.constant = 0, 0, 0, None, True
        self.codes: list[int] = []  # of a text slot: hashes of different pages, CONSTANT_PAGES at most

    def pack(self) -> list:
        return [int(self.optional) + 2 * self.repeated + 4 * self.mixed + 8 * self.constant, self.pages, self.chars, self.links, self.text, self.codes, {k: n.pack() for k, n in self.inner.items()}]

    @classmethod
    def unpack(cls, packed: list) -> Node:
        node = cls()
        flags, node.pages, node.chars, node.links, node.text, node.codes, inner = packed
        node.optional, node.repeated, node.mixed, node.constant = bool(flags & 1), bool(flags & 2), bool(flags & 4), bool(flags & 8)
        node.inner = {k: cls.unpack(v) for k, v in inner.items()}
        return node

    def expression(self, key: str = "") -> str:
        """The wrapper as a regular expression over tokens."""
        parts = " ".join(n.expression(k) for k, n in self.inner.items())
        body = "#" if key == "#" else f"<{key}> {parts} </>" if parts else f"<{key}/>"
        if self.mixed and parts:
            body = f"<{key}> ({parts})+ </>"
        return f"({body})" + ("*" if self.optional and self.repeated else "?" if self.optional else "+") if self.optional or self.repeated else body


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def blocks(page: str | None) -> Iterator[tuple[tuple[tuple[str, int], ...], str, int]]:
    """(path of (key, number of the element), text, characters in links) of each text block, in page order."""
    if not page:
        return
    stack: list[tuple[str, str, int]] = []  # tag, key, number
    links = 0
    pieces: list[str] = []
    linked = count = 0
    at, size = 0, len(page)

    def block():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        n = linked
        pieces.clear()
        linked = 0
        return (tuple((k, i) for _, k, i in stack), text, n) if text else None

    while at < size:
        m = TOKEN.match(page, at)
        if m is None:  # a tag with a quote that never ends, or without an end
            at = page.find(">", at) + 1
            if not at:
                break
            continue
        at = m.end()
        text = m[4]
        if text is not None:
            pieces.append(text)
            linked += len(text.strip()) if links else 0
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag in RAW and tag != "head":
            if not closing and not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            continue
        if found := block():
            yield found
        links = 0
        if tag in VOID:
            continue
        if closing:
            if any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "body":
            while stack and stack[-1][0] == "head":
                stack.pop()
        ends = ENDS.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            t = stack[k][0]
            if t in ends or (t == "p" and tag in ENDS_P):
                del stack[k:]
                break
            if t in HOLDS and not (tag in ENDS_P and t == "p"):
                break
        if m[3].endswith("/") and tag not in HOLDS and tag not in ENDS:
            continue
        names = {n.lower(): (a or b or c) for n, a, b, c in ATTRIBUTE.findall(m[3])}
        label = " ".join(filter(None, (names.get("class"), names.get("id"), names.get("role"))))
        label = re.sub(r"\d+", "0", " ".join(label.split()))
        if len(label) > 80:  # short, but different labels stay different
            label = f"{label[:60]} {zlib.crc32(label.encode('utf-8', 'surrogatepass'))}"
        count += 1
        stack.append((tag, f"{tag}.{label}" if label else tag, count))
    if found := block():
        yield found


def spare(key: str) -> str:
    """The token for a key beyond the bound, which is_off() and is_main() judge like the key."""
    tag = key.partition(".")[0]
    if key in SPARE:
        return key
    if is_off(key, True):
        return "nav.*"
    if tag in ("article", "main"):
        return f"{tag}.*"
    return "section.main *" if is_main(key) else "*"


def kinds(keys: Iterable[str]) -> int:
    return sum(k != "#" and k not in SPARE for k in keys)


def page_wrapper(page: str | None) -> Node:
    """A page's own wrapper, folded."""
    root = Node()
    root.pages = 1
    own = [zlib.crc32((page or "").encode("utf-8", "surrogatepass"))]
    seen: dict[int, Node] = {0: root}
    last: dict[int, str] = {}
    told: set[int] = set()
    for path, text, links in blocks(page):
        parent, number = root, 0
        for key, n in (*path, ("#", -1)):
            if key.startswith("head") and (key == "head" or key.startswith("head.")):
                break
            if key not in parent.inner and key != "#" and len(parent.inner) >= KINDS and kinds(parent.inner) >= KINDS:
                key = spare(key)
            node = parent.inner.get(key)
            if node is None:
                node = parent.inner[key] = Node()
                node.pages = 1
            elif (n == -1 and number in told) or (n != -1 and n not in seen):
                node.repeated = True
                if last.get(number) != key:
                    parent.mixed = True
            last[number] = key
            if n == -1:
                told.add(number)
            if n != -1:
                seen[n] = node
                number = n
            parent = node
        else:
            code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            parent.constant = parent.constant and parent.text in (None, code)
            parent.text = code if parent.text is None else parent.text
            parent.codes = own
            parent.chars += len(text)
            parent.links += min(links, len(text))
    return root


def common_order(a: list[str], b: list[str]) -> list[str]:
    """The keys of both, once each, around a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return list(dict.fromkeys(out))


def merge(a: Node, b: Node) -> Node:
    """The wrapper of what either matches."""
    out = Node()
    out.optional, out.repeated, out.mixed = a.optional or b.optional, a.repeated or b.repeated, a.mixed or b.mixed
    out.pages, out.chars, out.links = a.pages + b.pages, a.chars + b.chars, a.links + b.links
    out.codes = a.codes if a.codes == b.codes else sorted({*a.codes, *b.codes})[:CONSTANT_PAGES]
    out.text = a.text if a.text is not None else b.text
    out.constant = a.constant and b.constant and (a.text is None or b.text is None or a.text == b.text)
    keys = list(a.inner) if a.inner.keys() == b.inner.keys() and list(a.inner) == list(b.inner) else common_order(list(a.inner), list(b.inner))
    if len(keys) < len(a.inner.keys() | b.inner.keys()):
        raise AssertionError("a token was lost")
    crossed = [k for k in keys if k in a.inner] != list(a.inner) or [k for k in keys if k in b.inner] != list(b.inner)
    out.mixed = out.mixed or crossed
    beyond: set[str] = set()
    if len(keys) > KINDS and kinds(keys) > KINDS:
        own = [k for k in keys if k != "#" and k not in SPARE]
        own.sort(key=lambda k: -sum(n.inner[k].pages for n in (a, b) if k in n.inner))
        beyond = set(own[KINDS:])
    for k in keys:
        for node in filter(None, (a.inner.get(k), b.inner.get(k))):
            to = spare(k) if k in beyond else k
            if to in out.inner:
                out.inner[to] = merge(out.inner[to], node)
            else:
                out.inner[to] = node = Node.unpack(node.pack())
                node.optional = node.optional or k in beyond or not (k in a.inner and k in b.inner)
    return out


def is_off(key: str, in_main: bool, by_name: bool = True) -> bool:
    """Whether an element is for anything but main text; a heading part of an article is no page header.  by_name: whether
    class names count."""
    tag, _, label = key.partition(".")
    if tag in OFF_TAGS or (tag == "header" and not in_main):
        return True
    names = {x.lower() for x in OFF_NAMES.findall(label.replace(" ", "  ").replace("-", "--").replace("_", "__"))} if label else set()
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return bool(names & COMMENT_NAMES)
    if in_main or MAIN_NAMES.search(label):
        names.discard("header")
    return bool(names if by_name else names & COMMENT_NAMES)


def is_main(key: str) -> bool:
    tag, _, label = key.partition(".")
    return tag in ("article", "main") or (tag in ("div", "section") and bool(MAIN_NAMES.search(label)))


MAIN_TESTS: tuple[Callable[[str], bool], ...] = (lambda k: k.partition(".")[0] == "article", lambda k: k.partition(".")[0] == "main", is_main)


LISTS = frozenset("ul ol dl table".split())
Path = tuple[str, ...]


def slots_of(wrapper: Node) -> dict[Path, Node]:
    """The text slots by their path."""
    out: dict[Path, Node] = {}

    def walk(node: Node, path: Path) -> None:
        for k, n in node.inner.items():
            if k == "#":
                out[path] = n
            else:
                walk(n, (*path, k))

    walk(wrapper, ())
    return out


def same_everywhere(slot: Node) -> bool:
    """Whether a slot is a part of the template: one text on CONSTANT_PAGES different pages."""
    return slot.constant and len(slot.codes) >= CONSTANT_PAGES


class Keep:
    """What a wrapper says about its pages: path in Keep(wrapper) tells whether the block at a path of keys is to be kept."""

    def __init__(self, wrapper: Node):
        self.wrapper = wrapper
        slots = slots_of(wrapper)
        changing = {p: n.chars - n.links for p, n in slots.items() if not same_everywhere(n)}
        self.spared = self._spared(changing)
        prose = {p: n for p, n in slots.items() if n.links <= LINK_SHARE * n.chars and not self.off(p)}
        total = sum(n.chars for n in prose.values())
        self.test: Callable[[str], bool] | None = None
        self.part: Path = ()
        for test in MAIN_TESTS:
            inside = {p for p in prose if any(test(k) for k in p)}
            if inside and 4 * sum(prose[p].chars for p in inside) >= total:
                self.test = test
                self.slots = inside | {p for p in slots if not self.off(p) and self.links_stay(p)}
                if test is is_main:  # a mere name: the heading may stand before the part of that name
                    parts = {p[: 1 + next(i for i, k in enumerate(p) if test(k))] for p in inside}
                    self.slots |= {p for p in prose if p in changing and any(self._heading(p, part) for part in parts)}
                return
        self.part = self._dominant({p: self._weight(p, n) for p, n in prose.items() if p in changing})
        self.slots = {p for p, n in prose.items() if p in changing and self.inside(p)}

    def _spared(self, changing: dict[Path, int]) -> Path | None:
        """The part that only its class name calls a menu or the like, but that holds most of the changing prose."""
        parts: dict[Path, int] = {}
        for p, n in changing.items():
            main = False
            for i, k in enumerate(p):
                if is_off(k, main, by_name=False):
                    break
                if is_off(k, main):
                    parts[p[: i + 1]] = parts.get(p[: i + 1], 0) + n
                    break
                main = main or is_main(k)
        rest = sum(n for p, n in changing.items() if not self._off(p, None)) + sum(parts.values())
        best = max(parts, key=lambda p: parts[p], default=None)
        return best if best is not None and 2 * parts[best] > rest else None

    @staticmethod
    def _off(path: Path, spared: Path | None) -> bool:
        main = False
        for i, k in enumerate(path):
            if k.partition(".")[0] == "head" or is_off(k, main, by_name=path[: i + 1] != spared):
                return True
            main = main or is_main(k)
        return False

    def off(self, path: Path) -> bool:
        return self._off(path, self.spared)

    def _weight(self, path: Path, slot: Node) -> int:
        """Changing prose; in repeated or optional parts of the wrapper it counts double."""
        node, loose = self.wrapper, slot.repeated or slot.optional
        for k in path:
            node = node.inner[k]
            loose = loose or node.repeated or node.optional or node.mixed
        return (slot.chars - slot.links) * (2 if loose else 1)

    def _dominant(self, weights: dict[Path, int]) -> Path:
        """The lowest element on the way down from the root that holds DOMINANT of the weight; not a single block's own."""
        part: Path = ()
        while True:
            held: dict[str, int] = {}
            for p, n in weights.items():
                if p[: len(part)] == part and len(p) > len(part) + 1:
                    held[p[len(part)]] = held.get(p[len(part)], 0) + n
            best = max(held, key=lambda k: held[k], default=None)
            if best is None or held[best] < DOMINANT * sum(weights.values()):
                return part
            part = (*part, best)

    def _heading(self, path: Path, part: Path) -> bool:
        """Whether a path is a first or second heading that stands before a part, next to one of its elements."""
        k = len(path) - 1
        if not 0 <= k < len(part) or path[k].partition(".")[0] not in ("h1", "h2") or path[:k] != part[:k]:
            return False
        node = self.wrapper
        for key in path[:k]:
            node = node.inner[key]
        order = list(node.inner)
        return path[k] in order and order.index(path[k]) < order.index(part[k])

    def inside(self, path: Path) -> bool:
        """Whether a path is in the dominant part, or a heading of it."""
        return path[: len(self.part)] == self.part or self._heading(path, self.part)

    def links_stay(self, path: Path) -> bool:
        """Whether a block is kept even if it is mostly links: within the article, but for lists in a part of mere name."""
        return self.test is not None and any(self.test(k) for k in path) and (self.test is not is_main or not any(k.partition(".")[0] in LISTS for k in path))

    def __contains__(self, path: Path) -> bool:
        if path in self.slots:
            return True
        node: Node | None = self.wrapper
        for k in (*path, "#"):
            node = node.inner.get(k)
            if node is None:
                return not self.off(path) and (any(self.test(k) for k in path) if self.test else self.inside(path))
        return False


def known_share(own: Node, wrapper: Node) -> float:
    """The share of a page's (or wrapper's) text for which another has slots."""

    def found(a: Node, b: Node) -> tuple[int, int]:
        known = total = 0
        for k, n in a.inner.items():
            other = b.inner.get(k) or (b.inner.get(spare(k)) if k != "#" else None)
            if k == "#":
                total += n.chars
                known += n.chars if other else 0
            elif other:
                x, y = found(n, other)
                known, total = known + x, total + y
            else:
                total += sum(s.chars for s in slots_of(n).values())
        return known, total

    known, total = found(own, wrapper)
    return known / total if total else 1.0


def join_templates(wrappers: list[Node], more: list[Node]) -> list[Node]:
    """The templates of both lists, those that are alike merged."""
    out = list(wrappers)
    for own in more:
        alike = [max(known_share(own, w), known_share(w, own)) for w in out]
        best = max(range(len(out)), key=lambda i: alike[i], default=None)
        if best is None or (alike[best] < ALIKE and len(out) < TEMPLATES):
            out.append(own)
        else:
            out[best] = merge(out[best], own)
    return out


class Templates:
    """The wrappers of a host, each with what it says; of(page) is the one that fits a page."""

    def __init__(self, wrappers: list[Node]):
        self.keeps = [Keep(w) for w in wrappers]

    def of(self, page: str | None) -> Keep | None:
        if len(self.keeps) < 2:
            return self.keeps[0] if self.keeps else None
        own = page_wrapper(page)
        return max(self.keeps, key=lambda k: (known_share(own, k.wrapper), k.wrapper.pages))


def main_text(page: str | None, keep: Keep | None) -> str:
    """The blocks of a page in the slots to keep."""
    out = []
    for path, text, links in blocks(page):
        keys = tuple(k for k, _ in path)
        if keep is not None and keys in keep and (links <= LINK_SHARE * len(text) + 1 or keep.links_stay(keys)):
            out.append(text)
    return "\n\n".join(out)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def pack_all(wrappers: list[Node]) -> str:
    return json.dumps([n.pack() for n in wrappers])


def unpack_all(text: str) -> list[Node]:
    return [Node.unpack(x) for x in json.loads(text)]


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrappers) of every host; the wrappers as JSON of Node.pack()."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[Node]] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([salt] * len(found), pa.int32()), pa.array([pack_all(w) for w in found.values()])], names=["host", "salt", "wrappers"])

        for batch in batches:
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found[h] = join_templates(found.get(h, []), [page_wrapper(page)])
            if len(found) > 20_000:
                yield emit()
                found.clear()
        if found:
            yield emit()

    def merged(table: pa.Table) -> pa.Table:
        all_of: list[Node] = []
        for text in sorted(table.column("wrappers").to_pylist()):  # rows come in any order
            all_of = join_templates(all_of, unpack_all(text))
        return pa.table({"host": table.column("host").slice(0, 1), "salt": pa.array([0], pa.int32()), "wrappers": [pack_all(all_of)]})

    schema = "host string, salt int, wrappers string"
    picked = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    salted = picked.mapInArrow(parts, schema).groupBy("host", "salt").applyInArrow(merged, schema)
    return salted.groupBy("host").applyInArrow(merged, schema).select("host", "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page by its host's wrappers, which must be stored."""
    page = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host(F.col(url_col)).alias("host"))
    few = (wrappers.agg(F.sum(F.length("wrappers"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = page.join(F.broadcast(wrappers) if few else wrappers, "host", "left").select("_id", "_url", "_html", "wrappers")
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Templates] = {None: Templates([])}
        for batch in batches:
            out = []
            for page, packed in zip(batch.column("_html").to_pylist(), batch.column("wrappers").to_pylist(), strict=True):
                if packed not in known:
                    if len(known) > 500:
                        known.clear()
                    known[packed] = Templates(unpack_all(packed) if packed else [])
                out.append(main_text(page, known[packed].of(page)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(out, pa.string())], names=[id_col, url_col, "text"])

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the wrappers are inferred from all pages and stored, then applied to all pages."""
    return extract(pages, materialize(infer_wrappers(pages, url_col, html_col), "wrappers"), id_col, url_col, html_col)
