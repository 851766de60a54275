"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces of text.

Byte-level BPE never merges across pre-tokens, so a text may be cut wherever two pre-tokens meet, and its ids are those
of its pieces one after another.  Texts are cut before spaces, line ends, full stops and commas, by Arrow, many texts at
a time; a cut is certain to fall between pre-tokens if what stands before a space or line end is no white space, and
before a stop or comma is a letter or digit.  Texts with any other cut are split by the tokenizer's whole pattern.
Texts that hold an added token's content go through the library whole, one by one, as it looks for these first.
Pieces not seen before are encoded by the tokenizers library, many at a time as lines of one string; the rest come from
the memo: flat Arrow and NumPy columns of some 30 bytes an entry.  Above memo_entries the half that was met least goes,
so memory is bounded.  A tokenizer of any other kind encodes whole texts directly.

An encoder lives as long as its Python worker (see encoder()), or until a task of another operator begins there.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import trim


#: The pre-token pattern of byte-level BPE, and the same for ASCII texts in the faster engine.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


CUT = "\x01"
#: Pieces that a worker's memo keeps: more cost memory, fewer cost time.
MEMO_ENTRIES = 400_000
#: Text that is cut at once, and new pieces that the library is given at once.
SLICE_BYTES = 4 << 20
LEARN_AT_ONCE = 16_000
BATCH_ROWS = 1500


class Encoder:
    """encode(texts) gives an array of ids per text; ids have the narrowest unsigned type that holds the vocabulary."""

    def __init__(self, spec: str, memo_entries: int = MEMO_ENTRIES, slice_bytes: int = SLICE_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        before = self.tokenizer.pre_tokenizer
        self.newline = self._library(["\n"])[0]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = not any("\n" in c for c in self.added) and self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and len(self.newline) == 1
        self.ascii, self.any = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        self.memo_entries, self.slice_bytes = memo_entries, slice_bytes
        # an entry: the piece, where its ids are in the pool, how many, what it begins and ends with, how often it was met
        self.pieces = pa.array([], pa.large_string())
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flags, self.met = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[str], begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Pieces whose ids are ids[begin : begin + size]."""
        self.pieces = pa.concat_arrays([self.pieces, pa.array(pieces, pa.large_string())])
        self.begin = np.concatenate([self.begin, begin + len(self.pool)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        # 1: may follow only a letter or digit, other pieces only what is no white space; 4, 8: ends with such
        flags = np.fromiter(((p[0] in ".,") + 4 * p[-1].isalnum() + 8 * (not p[-1].isspace()) for p in pieces), np.uint8, len(pieces))
        self.flags = np.concatenate([self.flags, flags])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, pieces: list[str], at_once: int = 200) -> None:
        """New pieces, all different: those of one line as lines of long strings."""
        # neither end may join a line end: no white space there but one space in front
        plain = [p for p in pieces if not p[-1].isspace() and not p[p[0] == " "].isspace() and "\n" not in p]
        other = list(set(pieces).difference(plain))
        # a line end before a piece is one of the line ends between the lines
        lined = [p for p in other if p[0] == "\n" and p.count("\n") == 1 and not p[-1].isspace() and not p[1].isspace()]
        lines = plain + [p[1:] for p in lined]
        if lines:
            got = self._library(["\n" + "\n".join(lines[i : i + at_once]) + "\n" for i in range(0, len(lines), at_once)])
            ends = [np.flatnonzero(g == self.newline[0]) for g in got]
            shift = np.cumsum([0] + [len(g) for g in got[:-1]])
            begin = np.concatenate([e[:-1] + s for e, s in zip(ends, shift, strict=True)]) + 1
            size = np.concatenate([np.diff(e) for e in ends]) - 1
            if len(begin) != len(lines):
                raise AssertionError("a line end met another token")
            begin[len(plain) :] -= 1
            size[len(plain) :] += 1
            self._add(plain + lined, begin, size, np.concatenate(got))
        if rest := list(set(other).difference(lined)):
            got = self._library(rest)
            size = np.fromiter(map(len, got), np.int64, len(got))
            self._add(rest, np.cumsum(size) - size, size, np.concatenate(got))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of some different pieces is in the memo; those that are not are learned.  Empty pieces: -1."""
        if len(self.pieces) > self.memo_entries:
            self._halve()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing, first = pieces.take(pa.array(unknown)), len(self.pieces)
            for i in range(0, len(missing), LEARN_AT_ONCE):
                if new := [p for p in missing.slice(i, LEARN_AT_ONCE).to_pylist() if p]:
                    self._learn(new)
            at = at.copy()
            at[unknown] = pc.fill_null(pc.add(pc.index_in(missing, value_set=self.pieces.slice(first)), first), -1).to_numpy(zero_copy_only=False)
        return at

    def _halve(self) -> None:
        """Keep the half of the memo that was met most; what was met before counts half from now on."""
        keep = np.sort(np.argpartition(-self.met, self.memo_entries // 2)[: self.memo_entries // 2])
        self.pool = self._gather(keep)
        self.pieces = self.pieces.take(pa.array(keep))
        self.size, self.flags, self.met = self.size[keep], self.flags[keep], self.met[keep] // 2
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at these places of the memo, one after another."""
        size = self.size[at].astype(np.int64)
        return self.pool[np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def _slow(self, text: str) -> np.ndarray:
        coded = pa.array(self.ascii(text) if text.isascii() else self.any(text), pa.large_string()).dictionary_encode()
        return self._gather(self._places(coded.dictionary)[coded.indices.to_numpy()])

    def encode_array(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow string array; null counts as empty."""
        if not self.split:
            yield from self._library([t or "" for t in texts.to_pylist()])
            return
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // self.slice_bytes)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(texts)], strict=True):
            if b > a:
                yield from self._encode_slice(pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), ""))

    def _encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        whole = np.zeros(len(texts), dtype=bool)
        for c in self.added:
            whole |= pc.match_substring(texts, c).to_numpy(zero_copy_only=False)
        bad = pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False) & ~whole
        out: dict[int, np.ndarray] = {}
        plain = np.flatnonzero(~whole & ~bad)
        if len(plain):
            marked = texts.take(pa.array(plain)) if len(plain) < len(texts) else texts
            for c in " \n.,":
                marked = pc.replace_substring(marked, c, CUT + c)
            lists = pc.split_pattern(marked, CUT)
            del marked
            count = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            del lists
            found = self._places(coded.dictionary)
            code = coded.indices.to_numpy()
            self.met[found[found >= 0]] += np.bincount(code, minlength=len(found))[found >= 0]
            at = found[code]
            del coded, code
            real = at >= 0
            owner = np.repeat(np.arange(len(plain), dtype=np.int32), count)[real]
            at = at[real]
            flags = self.flags[at]
            wrong = (owner[1:] == owner[:-1]) & (np.where(flags[1:] & 1, flags[:-1] & 4, flags[:-1] & 8) == 0)
            bad[plain[owner[1:][wrong]]] = True
            ends = np.cumsum(np.bincount(owner, weights=self.size[at], minlength=len(plain)).astype(np.int64))
            out = dict(zip(plain.tolist(), np.split(self._gather(at), ends[:-1]), strict=True))
        for k in np.flatnonzero(bad).tolist():
            out[k] = self._slow(texts[k].as_py())
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._library([texts[k].as_py()])[0]
        return [out[k] for k in range(len(texts))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return list(self.encode_array(pa.array(texts, type=pa.string())))


def encoder(spec: str, memo_entries: int = MEMO_ENTRIES, slice_bytes: int = SLICE_BYTES) -> Encoder:
    """One encoder per Python worker, whatever the number of tasks that it runs one after another."""
    held = sys.__dict__.setdefault("_quire_encoders", {})
    key = (zlib.crc32(spec.encode()), memo_entries, slice_bytes)
    if key not in held:
        held.clear()
        held[key] = Encoder(spec, memo_entries, slice_bytes)
    trim()
    return held[key]


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """(id, n_tokens, ids binary, counts binary): ids little-endian, 16 bits wide if the vocabulary allows, with the end id
    appended; counts is null there.  Each task ends with one row more, whose counts (64 bits each) say how often the task
    has met every id.  Null or empty text: the end id alone.  Repeated rows stay; other columns are ignored."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    id_type = df.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"`{id_col}` {id_type}, n_tokens bigint, ids binary, counts binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        end = np.array([end_id], dtype=enc.dtype)
        total = np.zeros(enc.tokenizer.get_vocab_size(), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = [np.concatenate([x, end]) for x in enc.encode_array(batch.column(1))]
                total += np.bincount(np.concatenate(ids), minlength=len(total))
                columns = [batch.column(0), [len(x) for x in ids], [x.tobytes() for x in ids], [None] * len(ids)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((None, 0, b"", total.astype("<i8").tobytes()), arrow, strict=True)], schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def width(path: str | None = None) -> int:
    """Bytes of one id in the ids column of tokenize()."""
    with open(path or default_path(), encoding="utf-8") as f:
        return Encoder(f.read()).dtype.itemsize
