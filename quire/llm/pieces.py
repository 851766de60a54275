"""SentencePiece: ids of whole texts and texts of ids, by the sentencepiece library.

A model whose pieces hold the white-space mark only in front can't join anything across a cut before a mark that follows
another character.  So a text, marked as the library marks it, is cut there by Arrow; the distinct chunks of a slice of
texts make a table that the library segments once, and ids are joined back by the chunks' positions, as codes into that
table.  The table is that of a slice of SLICE_BYTES, not of the corpus: one of the corpus would send every position of
every text through a shuffle, several times the input, to save segmenting a quarter of the text.

Texts that hold SEPARATOR, and all texts under a model that cuts() refuses, go through the library whole.

Cases: null and empty texts have the begin and end ids alone; null ids decode to null; equal rows give equal results, each
its own; a text of any length is encoded whole; an empty table gives no rows.  Columns other than the id and the text or
ids are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_rows

MARK, SEPARATOR = "▁", "\x01"
#: Text whose distinct chunks are segmented at once, and ids that are decoded at once.
SLICE_BYTES = 16 << 20
SLICE_IDS = 1 << 18
#: Texts that a normalizer which does more than mark spaces would change.
PROBES = ["a  b", " a", "a ", "a\tb\r\n\nc", "ﬁ ½ ① é Ａ　b", " ​­\x00\x7f", "Aİß"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def cuts(sp) -> bool:
    """Whether texts may be cut before marks: no piece holds a mark behind another character, the mark alone is a piece,
    and normalizing only puts a mark in front and for each space."""
    inner = re.compile(f"[^{MARK}]{MARK}").search
    plain = all(sp.normalize(x) == MARK + x.replace(" ", MARK) for x in PROBES)
    return plain and not sp.is_unknown(sp.piece_to_id(MARK)) and not any(inner(sp.id_to_piece(k)) for k in range(sp.vocab_size()))


class Encoder:
    """encode(texts) gives an array of ids for each text of an Arrow string array, without begin and end."""

    def __init__(self, model: bytes):
        self.sp = processor(model)
        self.cut = cuts(self.sp)
        self.alone = [self.sp.piece_to_id(MARK)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.sp.encode(texts, num_threads=1)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE_BYTES)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(texts)], strict=True):
            if b > a:
                part = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
                yield from self._slice(part) if self.cut else self.whole(part.to_pylist())

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        held = pc.match_substring(texts, SEPARATOR).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(held).tolist():
            out[k] = self.whole([texts[k].as_py()])[0]
        plain = np.flatnonzero(~held)
        if len(plain):
            for k, ids in zip(plain.tolist(), self._chunked(texts.take(pa.array(plain)) if held.any() else texts), strict=True):
                out[k] = ids
        return out

    def _chunked(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(texts, " ", MARK)
        # the mark in front of a text is left out here, and of every other chunk below: the library puts it there
        lists = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}]){MARK}", f"\\1{SEPARATOR}"), SEPARATOR)
        del marked
        count = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        del lists
        chunks = coded.dictionary.to_pylist()
        found = self.sp.encode(chunks, num_threads=1)
        if "" in chunks:  # a mark alone
            found[chunks.index("")] = self.alone
        size = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        del found, chunks
        begin, code = np.cumsum(size) - size, coded.indices.to_numpy()
        # a text without a character has no mark in front
        owner = np.repeat(np.arange(len(count)), count)
        real = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)[owner]
        code, owner = code[real], owner[real]
        n = size[code]
        ids = pool[np.repeat(begin[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ends = np.cumsum(np.bincount(owner, weights=n, minlength=len(count)).astype(np.int64))
        return np.split(ids, ends[:-1])


def _model(df: DataFrame, path: str | None):
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, between the begin and end ids."""
    model = _model(df, path)

    def make():
        enc = Encoder(model.value)
        bos, eos = (np.array([k], np.uint32) for k in (enc.sp.bos_id(), enc.sp.eos_id()))

        def step(batch: pa.RecordBatch) -> dict:
            ids = [np.concatenate([bos, x, eos]) for x in enc.encode(batch.column(1))]
            return {id_col: batch.column(0), "n_tokens": [len(x) for x in ids], "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}

        return step

    id_type = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(f"`{id_col}`", f"`{text_col}`"), f"`{id_col}` {id_type}, n_tokens bigint, ids binary", make)


def kinds_of(sp) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: whether its piece opens with the mark, and whether it has any text (control ids have none)."""
    ids = range(sp.vocab_size())
    return np.array([sp.id_to_piece(k).startswith(MARK) for k in ids]), np.array([not sp.is_control(k) for k in ids])


def decode_ids(sp, ids: np.ndarray, kinds: tuple[np.ndarray, np.ndarray]) -> str:
    """The library's text of ids.  Many ids are cut before a piece that opens with the mark and isn't the first with text:
    its space is the one that the library leaves out in front of a text."""
    opens, shown = kinds
    edges, least = [0], int(np.argmax(shown[ids])) + 1 if len(ids) else 0
    while (at := max(edges[-1] + SLICE_IDS, least)) < len(ids) and len(k := np.flatnonzero(opens[ids[at:]])):
        edges.append(at + int(k[0]))
    return " ".join(sp.decode(ids[a:b].tolist()) for a, b in zip(edges, [*edges[1:], len(ids)], strict=True))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns in keep, decoded): the library's decode(ids) of ids as encode() gives them."""
    model = _model(df, path)

    def make():
        sp = processor(model.value)
        kinds = kinds_of(sp)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [None if x is None else decode_ids(sp, np.frombuffer(x, "<u4"), kinds) for x in (x.as_py() for x in batch.column(ids_col))]
            return {**{c: batch.column(c) for c in (id_col, *keep)}, "decoded": texts}

        return step

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return map_rows(df.select(*[f"`{c}`" for c in dict.fromkeys((id_col, ids_col, *keep))]), f"{kept}, decoded string", make)
