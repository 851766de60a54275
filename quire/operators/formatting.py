"""Formatted proof text in full: tokens that cover their source, styles with their rules, notes, blocks, all warnings.

Only the scan of one page's text is Python, in Arrow batches, linear in the text; rules of projects are an equi-join, and
labels, states, warnings and verdicts are column expressions.  Places are half-open: characters and bytes (UTF-8) of the
source, graphemes of the visible text.

Null text is an empty page.  A construct that is not closed takes the rest of its page.  An empty style has no span.  An
unknown tag hides all tags up to its closing tag.  Rows that are equal give equal results, no rows give none; columns of
the input stay, and the result is one more column, `into`, whose name must not be among them.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.labels import is_sha256, lookup

# Tags and their labels, scripts, contexts of blocks, labels that a rule may give, warnings that keep a page
# out of training (two others, letter_space_removed and small_caps_case_normalized, do not).
LABELS = {"i": "italic", "b": "bold", "sc": "small_caps", "g": "letter_spaced", "^": "superscript", "_": "subscript"}
BY_RULE = {"f": "font_other_reviewed", "u": "underline"}
STYLES = ("i", "b", "sc", "g", "f", "u")
CONTEXTS = {"/*": "poetry_block", "/#": "display_block"}
RULE_LABELS = {"u": ["underline"], "f": ["font_blackletter", "font_antiqua", "font_upright_in_italic", "font_other_reviewed"]}
RULE_MISSING = {"f": "ambiguous_font_change", "u": "unapproved_underline"}
BLOCKING = [
    "ambiguous_font_change", "invalid_construct", "mismatched_close_tag", "note_quarantine", "unapproved_underline", "unclosed_note",
    "unclosed_block", "unclosed_tag", "unclosed_unknown_tag", "unknown_construct", "unmatched_block", "crossed_block",
]

TAG = re.compile(r"<(?P<slash>/?)(?P<name>[^\s</>]++)(?P<rest>[^<>]*+)>")
STOP = {False: re.compile(r"\[\*\*|/[*#]|[*#]/|[<^_]"), True: re.compile(r"\[\*\*|/[*#]|[*#]/|[<^_ ]")}
GRAPHEME = regex.compile(r"\X")

TOKEN = "struct<kind:string,text:string,visible:string,start:int,end:int,byte_start:int,byte_end:int>"
PAGE = (
    "struct<visible:string,spans:array<struct<tag:string,start:int,end:int,byte_start:int,byte_end:int>>,"
    "unclosed:array<struct<tag:string,byte_start:int,byte_end:int>>,"
    "notes:array<struct<text:string,content:string,question:boolean,byte_start:int,byte_end:int>>,contexts:array<string>,"
    "lowered:array<struct<grapheme:int,text:string>>,flaws:array<struct<code:string,byte_start:int,byte_end:int>>>"
)
LETTER = "struct<pos:int,text:string,slices:array<struct<start:int,end:int>>>"


class Scan:
    """One pass over a page: `tokens` (kind, start, end, first and last visible character) and `flaws` (code, start, end)."""

    def __init__(self, text: str):
        self.text, self.tokens, self.flaws = text, [], []
        self.tags = {m.start(): m for m in TAG.finditer(text)}
        self.closing: dict[str, list[re.Match]] = {}
        for m in self.tags.values():
            if m["slash"]:
                self.closing.setdefault(m["name"], []).append(m)
        self.open: list[tuple[str, int, int]] = []
        self.spaced = at = plain = 0
        while stop := STOP[self.spaced > 0].search(text, at):
            begin, before = stop.start(), len(self.tokens)
            at = self.construct(begin, stop[0])
            if len(self.tokens) > before:
                if begin > plain:
                    self.tokens.insert(before, ("text", plain, begin, plain, begin))
                plain = at
        if plain < len(text):
            self.tokens.append(("text", plain, len(text), plain, len(text)))
        self.flaws += [("unclosed_tag", a, b) for _, a, b in self.open]

    def add(self, kind: str, begin: int, end: int, shown: tuple[int, int] | None = None) -> int:
        self.tokens.append((kind, begin, end, *(shown or (begin, begin))))
        return end

    def raw(self, begin: int, end: int, code: str | None = None) -> int:
        """Source that stays visible as it is."""
        if code:
            self.flaws.append((code, begin, end))
        return self.add("unknown", begin, end, (begin, end)) if end > begin else end

    def construct(self, begin: int, mark: str) -> int:
        """Tokens of what begins here, if anything does; the place to go on from."""
        text, size = self.text, len(self.text)
        if mark == " ":
            return self.add("normalization", begin, begin + 1)
        if mark == "[**":
            end = text.find("]", begin) + 1
            if end:
                return self.add("note", begin, end)
            self.flaws.append(("unclosed_note", begin, size))
            return self.add("unknown", begin, size)
        if mark == "<":
            return self.tag(begin)
        if mark in "^_":
            return self.script(begin, "superscript" if mark == "^" else "subscript")
        return self.add("block_open" if mark[0] == "/" else "block_close", begin, begin + 2)

    def script(self, begin: int, kind: str) -> int:
        text, size = self.text, len(self.text)
        after = text[begin + 1 : begin + 2]
        if after == "{":
            end = text.find("}", begin + 2)
            return self.add(kind, begin, end + 1, (begin + 2, end)) if end > begin + 2 else self.raw(begin, size, "invalid_construct")
        if not after:
            return self.raw(begin, size, "invalid_construct")
        return begin + 1 if after.isspace() or after in "<>[]{}" else self.add(kind, begin, begin + 2, (begin + 1, begin + 2))

    def tag(self, begin: int) -> int:
        m, size = self.tags.get(begin), len(self.text)
        if m is None:
            return self.raw(begin, size, "invalid_construct") if self.text[begin + 1 : begin + 2].isalpha() else begin + 1
        name, end = m["name"], m.end()
        if not m["rest"] and name in STYLES:
            if not m["slash"]:
                self.open.append((name, begin, end))
                self.spaced += name == "g"
                return self.add("open_tag", begin, end)
            if self.open and self.open[-1][0] == name:
                self.open.pop()
                self.spaced -= name == "g"
            else:
                self.flaws.append(("mismatched_close_tag", begin, end))
            return self.add("close_tag", begin, end)
        self.raw(begin, end, "unknown_construct")
        if m["slash"] or m["rest"].startswith("/"):
            return end
        others = self.closing.get(name, [])
        k = bisect.bisect_left(others, end, key=re.Match.start)
        if k == len(others):
            self.flaws.append(("unclosed_unknown_tag", begin, end))
            return self.raw(end, size)
        self.raw(end, others[k].start())
        return self.raw(others[k].start(), others[k].end())


def byte_places(text: str) -> list[int] | range:
    """The byte at which each character begins, and the end."""
    if text.isascii():
        return range(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return [0, *np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).tolist()]


def lex(text: str) -> list[dict]:
    """Tokens of a page in order; their sources make up its text."""
    at = byte_places(text)
    return [{"kind": k, "text": text[a:b], "visible": text[v:w], "start": a, "end": b, "byte_start": at[a], "byte_end": at[b]} for k, a, b, v, w in Scan(text).tokens]


def visible_graphemes(text: str, tokens: list[tuple]) -> list[tuple[str, list[tuple[int, int]]]]:
    """Each visible grapheme with the characters of the source it came from, in runs that meet joined."""
    source = list(itertools.chain.from_iterable(range(v, w) for *_, v, w in tokens))
    out = []
    for m in GRAPHEME.finditer("".join(text[v:w] for *_, v, w in tokens)):
        runs: list[tuple[int, int]] = []
        for c in source[m.start() : m.end()]:
            runs[-1:] = [(runs[-1][0], c + 1)] if runs and runs[-1][1] == c else [*runs[-1:], (c, c + 1)]
        out.append((m[0], runs))
    return out


def parse(text: str) -> dict:
    """A page as `PAGE`; labels of tags that need a rule aren't decided here."""
    scan, at = Scan(text), byte_places(text)
    visible = "".join(text[v:w] for *_, v, w in scan.tokens)
    begins = [m.start() for m in GRAPHEME.finditer(visible)]
    flaws, spans, styles, blocks, notes, contexts, shown = list(scan.flaws), [], [], [], [], [], 0

    def span(tag: str, first: int, last: int, a: int, b: int) -> None:
        i, j = bisect.bisect_left(begins, first), bisect.bisect_left(begins, last)
        if i < j:
            spans.append({"tag": tag, "start": i, "end": j, "byte_start": at[a], "byte_end": at[b]})

    for kind, a, b, v, w in scan.tokens:
        if kind == "open_tag":
            styles.append((text[a + 1 : b - 1], a, b, shown))
        elif kind == "close_tag":
            if styles and styles[-1][0] == text[a + 2 : b - 1]:
                tag, begin, _, first = styles.pop()
                span(tag, first, shown, begin, b)
        elif kind in ("superscript", "subscript"):
            span(text[a], shown, shown + w - v, a, b)
        elif kind == "block_open":
            blocks.append((a, b))
            contexts += [c for c in [CONTEXTS[text[a:b]]] if c not in contexts]
        elif kind == "block_close":
            if not blocks:
                flaws.append(("unmatched_block", a, b))
            elif text[slice(*blocks[-1])] != text[a:b][::-1]:
                flaws.append(("crossed_block", a, b))
            else:
                blocks.pop()
        elif kind == "normalization":
            flaws.append(("letter_space_removed", a, b))
        elif kind == "note" or (kind == "unknown" and text.startswith("[**", a)):
            content = text[a + 3 : b - 1 if kind == "note" else b]
            flaws.append(("note_quarantine", a, b))
            notes.append({"text": text[a:b], "content": content, "question": "?" in content, "byte_start": at[a], "byte_end": at[b]})
        shown += w - v
    flaws += [("unclosed_block", a, b) for a, b in blocks]
    edges, lowered = [*begins, len(visible)], []
    for s in (s for s in spans if s["tag"] == "sc"):
        for i in range(s["start"], s["end"]):
            letter = visible[edges[i] : edges[i + 1]]
            if letter.casefold() != letter:
                lowered.append({"grapheme": i, "text": letter.casefold()})
    return {
        "visible": visible, "spans": spans, "unclosed": [{"tag": t, "byte_start": at[a], "byte_end": at[b]} for t, a, b, _ in styles],
        "notes": notes, "contexts": contexts, "lowered": lowered,
        "flaws": [{"code": c, "byte_start": at[a], "byte_end": at[b]} for c, a, b in flaws],
    }


def _with(df: DataFrame, text: str, into: str, ddl: str, make) -> DataFrame:
    """df and a column `into`, made from its text in Arrow batches; the other columns pass untouched."""
    from pyspark.sql.pandas.types import to_arrow_type

    if into.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"there is a column {into} already")
    # What a page gives is far larger than the page, so few pages are held at a time.
    schema, step = StructType.fromDDL(f"`{into}` {ddl}").fields[0], 64
    place, arrow = df.columns.index(text), to_arrow_type(schema.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = pa.array([make(t or "") for t in part.column(place).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, schema]))


def tokens(df: DataFrame, text: str, into: str = "token") -> DataFrame:
    """A row per token, numbered by `pos` in it; the columns of df but for the text stay."""
    found = _with(df, text, into, f"array<{TOKEN}>", lex)
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return found.select(*kept, F.posexplode(into).alias("_pos", into)).select(*kept, F.struct(F.col("_pos").alias("pos"), F.col(f"`{into}`.*")).alias(into))


def graphemes(df: DataFrame, text: str, into: str = "grapheme") -> DataFrame:
    """A row per visible grapheme: its place, its text and the bytes of the source that it came from."""

    def make(t: str) -> list[dict]:
        at = byte_places(t)
        return [{"pos": i, "text": g, "slices": [{"start": at[a], "end": at[b]} for a, b in runs]} for i, (g, runs) in enumerate(visible_graphemes(t, Scan(t).tokens))]

    found = _with(df, text, into, f"array<{LETTER}>", make)
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return found.select(*kept, F.explode(into).alias(into))


def bad_rules(rules: DataFrame) -> DataFrame:
    """Rules (project, comments_sha256, tag, label, rule_ref) that can't be used, with the reason."""
    allowed = F.lit(False)
    for tag, names in RULE_LABELS.items():
        allowed = allowed | ((F.col("tag") == tag) & F.col("label").isin(names))
    repeated = rules.groupBy("project", F.lower("comments_sha256").alias("comments_sha256"), "tag").agg(F.count("*").alias("n")).where("n > 1").select("project", "comments_sha256", "tag", F.lit("repeated").alias("reason"))
    reason = F.when(~F.coalesce(is_sha256(F.lower("comments_sha256")), F.lit(False)), "no hash").when(~F.coalesce(allowed, F.lit(False)), "label not allowed")
    return rules.select("project", "comments_sha256", "tag", reason.alias("reason")).where("reason is not null").unionByName(repeated)


def _rules_of_pages(df: DataFrame, project: str, comments: str, rules: DataFrame) -> DataFrame:
    """df with `_rules`: tag -> (label, rule_ref), by project and hash of its comments; two tags at most for each."""
    known = rules.groupBy(F.col("project").alias("_p"), F.lower("comments_sha256").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("label", "rule_ref")))).alias("_rules"))
    hashed = df.withColumn("_own", F.sha2(F.col(f"`{comments}`").cast("binary"), 256))
    return hashed.join(known, (F.col(f"`{project}`") == F.col("_p")) & (F.col("_own") == F.col("_h")), "left").select(*[F.col(f"`{c}`") for c in df.columns], "_rules")


def _missing(tag: Column, rule: Column) -> Column:
    """Warnings of a style: its case was normalized, or no rule tells what it means."""
    codes = F.when(tag == "sc", F.array(F.lit("small_caps_case_normalized"))).when(rule.isNull() & tag.isin(*RULE_MISSING), F.array(lookup(RULE_MISSING)[tag]))
    return F.coalesce(codes, F.array().cast("array<string>"))


def records(df: DataFrame, text: str, project: str | None = None, comments: str | None = None, rules: DataFrame | None = None, into: str = "page") -> DataFrame:
    """df and `into`: visible text; spans with label, state, tier and rule; notes; contexts of blocks; letters made small;
    flaws with their bytes; all warnings, sorted; whether the page may train a model.

    `f` and `u` mean what a rule says that was made for the page's project and the very bytes of its comments; without one
    they are unknown, and the page is set apart.
    """
    if rules is None:
        df, plain = df.withColumn("_rules", F.lit(None).cast("map<string,struct<label:string,rule_ref:string>>")), df.columns
    else:
        df, plain = _rules_of_pages(df, project, comments, rules), df.columns
    found = _with(df, text, into, PAGE, parse)
    page = lambda name: F.col(f"`{into}`.{name}")

    def styled(s: Column) -> Column:
        rule = F.try_element_at(F.col("_rules"), s["tag"])
        known = F.coalesce(lookup(LABELS)[s["tag"]], rule["label"])
        return F.struct(
            F.coalesce(known, lookup(BY_RULE)[s["tag"]]).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end"),
            F.when(known.isNotNull(), "positive").otherwise("unknown").alias("state"), F.when(known.isNotNull(), "gold").otherwise("quarantine").alias("tier"),
            rule["rule_ref"].alias("rule_ref"), _missing(s["tag"], rule).alias("warnings"),
        )

    by_style = F.flatten(F.transform(F.concat(page("spans.tag"), page("unclosed.tag")), lambda t: _missing(t, F.try_element_at(F.col("_rules"), t))))
    warnings = F.array_sort(F.array_distinct(F.concat(page("flaws.code"), by_style)))
    made = found.withColumn("_w", warnings).select(
        *[F.col(f"`{c}`") for c in plain],
        F.struct(
            page("visible").alias("visible"), F.transform(page("spans"), styled).alias("spans"), page("unclosed").alias("unclosed"), page("notes").alias("notes"), page("contexts").alias("contexts"),
            page("lowered").alias("lowered"), page("flaws").alias("flaws"), F.col("_w").alias("warnings"), (~F.arrays_overlap("_w", F.array(*[F.lit(x) for x in BLOCKING]))).alias("trainable"),
        ).alias(into),
    )
    return made
