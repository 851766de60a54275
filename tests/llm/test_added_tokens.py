import random
import zlib

import numpy as np

from quire.llm import packing, token_codec, tokens

TEXTS = ["end <|endoftext|> start", "<|endoftext|>", "a.<|endoftext|><|endoftext|>\n\nb", "<|endoftext|", "plain text, no more", "", None, "x\n<|endoftext|>\n"]


def library():
    """The library's tokenizer as it is read from the file, with every setting as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_added_tokens_get_the_ids_of_the_library():
    r = random.Random(8)
    texts = TEXTS + ["".join(r.choice(["<|endoftext|>", " ", "\n", "word", ".", ",", "<|", "|>", "é"]) for _ in range(r.randint(1, 12))) for _ in range(500)]
    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read(), memo_entries=50)
    tokenizer = library()
    for part in (texts, texts[::-1]):
        for text, ids in zip(part, enc.encode(part), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert enc.encode(["end <|endoftext|> start"])[0].tolist() == [437, 220, 50256, 923]


def test_added_tokens_in_files_and_packing(spark):
    tokenizer = library()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in TEXTS]
    want = [(k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_codec.round_trip(df).collect()) == want
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packing.pack_documents(df).collect()) == want
