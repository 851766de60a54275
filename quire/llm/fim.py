"""Fill-in-the-middle: texts cut at two of their tokens, and the middle moved to the end.

Tokens are those of the tokenizers library's Split pre-tokenizer with PATTERN, isolated: runs of ASCII letters, and every
other code point by itself.  It needs no vocabulary and no training; its code-point offsets give the number of tokens of a
text and the places of two ranks among them.  Python returns these three numbers only; the texts stay in the JVM, which
slices and joins them.

The library is slow on long texts, and every space is a token by itself.  So texts are cut at spaces by Arrow, each
distinct piece of a slice of SLICE_BYTES is split once, and counts and offsets of texts are sums over their pieces.

Cases: a null text is empty; a null id is hashed as no digits; equal rows give equal results, each its own; a text of any
length is split whole, CUT code points at a time; an empty table gives no rows.  Columns other than the id and the text
are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Text whose pieces are looked up at once, and code points that the library is given at once.
SLICE_BYTES = 8 << 20
CUT = 1 << 16

_other = re.compile("[^A-Za-z]").search


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(PATTERN), behavior="isolated")


def starts(text: str, split) -> np.ndarray:
    """Where each token of a text begins, in code points.  What is no letter is a token by itself, so a long text is cut
    before one."""
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        m = _other(text, at + CUT) if at + CUT < len(text) else None
        end = m.start() if m else len(text)
        tokens = split.pre_tokenize_str(text[at:end])
        found.append(np.fromiter((span[0] for _, span in tokens), np.int64, len(tokens)) + at)
        at = end
    return np.concatenate(found)


def ranked_offsets(texts: pa.Array, ranks: list[np.ndarray], split) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each text, n, and for each of ranks the code points before the token of rank modulo (n + 1)."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    ends = lists.offsets.to_numpy()
    first, last = ends[:-1] - ends[0], ends[1:] - ends[0] - 1
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    distinct, size = coded.dictionary, pc.utf8_length(coded.dictionary).to_numpy()
    # all distinct pieces as one text, a space after each; begin: where they begin there, token: their first token's number
    token_at = starts(" ".join(distinct.to_pylist()) + " ", split)
    begin = np.cumsum(size + 1) - size - 1
    token = np.searchsorted(token_at, begin)
    tokens = np.searchsorted(token_at, begin + size) - token
    # tokens and code points before each piece of the slice; the space after a piece is one more of both
    before, chars = (np.cumsum(x[code] + 1) - x[code] - 1 for x in (tokens, size))
    n = before[last] + tokens[code[last]] - before[first]
    places = []
    for rank in ranks:
        goal = before[first] + rank % (n + 1)
        piece = np.searchsorted(before, goal, side="right") - 1
        places.append(chars[piece] + token_at[token[code[piece]] + goal - before[piece]] - begin[code[piece]] - chars[first])
    return n, places


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = (np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE_BYTES)) + 1).tolist()
    return ((a, b) for a, b in zip([0, *edges], [*edges, len(size)], strict=True) if b > a)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def cuts(text: pa.Array, rank: pa.Array, other: pa.Array) -> pa.Array:
    """Tokens of a text, and the code points before the smaller and the larger of two ranks modulo (n + 1)."""
    split, parts = splitter(), []
    ranks = [x.to_numpy(zero_copy_only=False) for x in (rank, other)]
    for a, b in _slices(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)):
        n, places = ranked_offsets(text.slice(a, b - a), [r[a:b] for r in ranks], split)
        parts.append((n, np.minimum(*places), np.maximum(*places)))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def draws(id_col: str, seed: str = "1") -> list[Column]:
    """Four numbers under 2^32 from the hash of the seed and the id."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output): form is plain, psm or spm; lengths in code points, null if
    plain.  Texts that are empty or hold a mark stay plain, and others by chance, as the id's hash says."""
    h = draws("_id", seed)
    text = F.col("text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    stays = (text == "") | marked | (h[2] % 100 >= 100 - plain)
    base = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    cut = base.withColumn("_cut", cuts("text", h[0], h[1])).withColumn("form", F.when(stays, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    a, b = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    psm, spm = ((PREFIX, prefix, SUFFIX, suffix), (SUFFIX, suffix, PREFIX, prefix))
    moved = lambda parts: F.concat(F.lit(parts[0]), parts[1], F.lit(parts[2]), parts[3], F.lit(MIDDLE), middle)
    cuts_text = F.col("form") != "plain"
    return cut.select(
        F.col("_id").alias(id_col), "text", F.col("_cut.n").alias("n"), "form",
        F.when(cuts_text, a.cast("long")).alias("prefix_chars"), F.when(cuts_text, (b - a).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", moved(psm)).when(F.col("form") == "spm", moved(spm)).otherwise(text).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of.  Texts that were cut hold no mark, so each mark is there once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    prefix = F.when(form == "psm", F.substring_index(after(PREFIX), SUFFIX, 1)).otherwise(F.substring_index(after(PREFIX), MIDDLE, 1))
    suffix = F.when(form == "psm", F.substring_index(after(SUFFIX), MIDDLE, 1)).otherwise(F.substring_index(after(SUFFIX), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))
