"""Proof markup: tokens with source offsets, style spans over visible graphemes, warnings; one page at a time."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Inline tags, block markers, the style of each tag, and warnings that keep a page out of training.
TAGS = {"i": "italics", "b": "bold", "sc": "small caps", "g": "letter spaced", "f": "font change", "u": "underline"}
BLOCKS = {"/*": "block_open", "*/": "block_close", "/#": "block_open", "#/": "block_close"}
BLOCKING = ["ambiguous_font_change", "invalid_construct", "mismatched_close_tag", "note_quarantine", "unapproved_underline", "unclosed_note", "unclosed_block", "unclosed_tag", "unclosed_unknown_tag", "unknown_construct", "unmatched_block", "crossed_block"]

# Characters of a slice of results, and what a row counts besides its own.
SLICE, COST = 1 << 20, 200

LEXER = regex.compile(
    r"(?P<note>\[\*\*[^\]]*\])|(?P<open_note>\[\*\*.*)|(?P<block>/\*|\*/|/\#|\#/)|(?P<tag></?(?:i|b|sc|g|f|u)>)"
    r"|(?P<unknown></?[A-Za-z][^<>\n]*>)|\^(?:\{(?P<super>[^{}]*)\}|(?P<super1>\w))|_\{(?P<sub>[^{}]*)\}|(?P<text>.)",
    regex.DOTALL,
)
GRAPHEME = regex.compile(r"\X")


def lex(text: str) -> list[dict]:
    """Tokens in order, whose sources cover the text: kind, text, visible text, start and end."""
    out: list[dict] = []

    def add(kind: str, m, visible: str) -> None:
        if kind == "text" and out and out[-1]["kind"] == "text":
            out[-1] |= {"text": out[-1]["text"] + m[0], "visible": out[-1]["visible"] + visible, "end": m.end()}
        else:
            out.append({"kind": kind, "text": m[0], "visible": visible, "start": m.start(), "end": m.end()})

    for m in LEXER.finditer(text):
        group = m.lastgroup
        if group == "note":
            add("note", m, "")
        elif group == "block":
            add(BLOCKS[m[0]], m, "")
        elif group == "tag":
            add("close_tag" if m[0][1] == "/" else "open_tag", m, "")
        elif group in ("super", "super1"):
            add("superscript", m, m[group])
        elif group == "sub":
            add("subscript", m, m[group])
        elif group in ("open_note", "unknown"):
            add("unknown", m, m[0])
        else:
            add("text", m, m[0])
    return out


def parse(text: str) -> dict:
    """Visible text, its style spans [start, end) in graphemes, warnings, and whether the page may train a model."""
    shown, size, spans, stack, blocks, warnings = [], 0, [], [], [], []
    for t in lex(text):
        kind = t["kind"]
        at = size
        if kind == "open_tag":
            stack.append((t["text"][1:-1], at))
        elif kind == "close_tag":
            if stack and stack[-1][0] == t["text"][2:-1]:
                name, begin = stack.pop()
                if at > begin:
                    spans.append({"label": TAGS[name], "start": begin, "end": at})
                if name == "u":
                    warnings.append("unapproved_underline")
            else:
                warnings.append("mismatched_close_tag")
        elif kind == "block_open":
            blocks.append(t["text"])
        elif kind == "block_close":
            if not blocks:
                warnings.append("unmatched_block")
            elif blocks.pop() != t["text"][::-1]:
                warnings.append("crossed_block")
        elif kind == "note":
            warnings.append("note_quarantine")
        elif kind == "unknown":
            warnings.append("unclosed_note" if t["text"].startswith("[**") else "unknown_construct")
        shown.append(t["visible"])
        size += len(t["visible"])
    visible = "".join(shown)
    starts = [m.start() for m in GRAPHEME.finditer(visible)]
    spans = [{**s, "start": bisect.bisect_left(starts, s["start"]), "end": bisect.bisect_left(starts, s["end"])} for s in spans]
    spans = [s for s in spans if s["start"] < s["end"]]
    warnings += ["unclosed_tag"] * len(stack) + ["unclosed_block"] * len(blocks)
    warnings = sorted(set(warnings))
    return {"visible": visible, "spans": spans, "warnings": warnings, "trainable": not set(warnings) & set(BLOCKING)}


def _each(df: DataFrame, key: str, text: str, fields: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([df.schema[key], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):  # one text at a time: a batch holds whole pages, and rows take many times their text
                k, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                for row in make(t):
                    rows.append({key: k, **row})
                    size += len(row.get("text", "")) + len(row["visible"]) + COST
                    if size >= SLICE:
                        yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()
                        rows, size = [], 0
            if rows:
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return df.select(key, text).mapInArrow(run, schema)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per token of each page."""
    return _each(df, key, text, "pos int, kind string, text string, visible string, start int, end int", lambda t: [{"pos": i, **x} for i, x in enumerate(lex(t))])


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per page: visible text, spans, warnings, trainable."""
    return _each(df, key, text, "visible string, spans array<struct<label:string,start:int,end:int>>, warnings array<string>, trainable boolean", lambda t: [parse(t)])
