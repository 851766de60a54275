"""Secret scan: Aho-Corasick keywords, anchored expressions at the hits, embedded checksums.

One pass of an automaton over the case-folded text finds every place where a keyword ends.  Only there is the
expression of the keyword's kind tried, anchored at the keyword's start.  Kinds whose format embeds a checksum
(base-62 CRC-32 tokens, Base58Check keys) are reported only if it is right.  Hexadecimal runs have no keyword; their
character class is scanned for directly.

Null or empty text: no spans.  A text of any length is scanned whole; repeated rows give repeated results; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
EXTENDED_KEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Kinds in the order that breaks ties of start; the first three are the base.
KINDS = ("assign", "access", "hex", "crc_token", "extended_key")
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "crc_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "extended_key": ("xprv",),
}
_FOLD = {c: c + 32 for c in range(65, 91)}


def base62_crc32(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def base58check(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


_RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "crc_token": (CRC_TOKEN, lambda m: base62_crc32(m[1]) == m[2]),
    "extended_key": (EXTENDED_KEY, lambda m: base58check(m[0])),
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, keywords in _KEYWORDS.items():
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind.  Per kind leftmost and non-overlapping: a match that
    fails its check still takes up its characters, as a plain left-to-right search would have it."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # the fold of a letter took two places
        low = text.translate(_FOLD)
    found, free = [], dict.fromkeys(_RULES, 0)
    for end, (kind, size) in keywords.iter(low):
        start = end + 1 - size
        if start >= free[kind]:
            pattern, valid = _RULES[kind]
            if m := pattern.match(text, start):
                free[kind] = m.end()
                if valid(m):
                    found.append((kind, start, m.end()))
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and spans array<struct<kind,start,end,value>>, code points, end exclusive."""

    def make():
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

        def step(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in scan(t, keywords)] for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "spans": pa.array(spans, type=kind)}

        return step

    id_type = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>", make)
