"""Language of texts by a linear-chain conditional random field over their words.

Words are runs of letters in lower case.  A word's features are its prefixes and suffixes of one to three letters, its
letter pairs and triples, and itself if the training sample has it often enough (the lexicon).  Emission and transition
weights are fitted by maximum conditional likelihood, with forward-backward gradients, on sequences of words whose label
is their document's language; a part of the sequences joins stretches of two documents, so that the transitions learn
code-switching.  A text's words are labelled by forward-backward over the whole text; its language is the label with the
largest sum of marginals, its score the mean of that label's marginals.

The model is fitted on a bounded sample: about SAMPLE_DOCS labelled documents of each language, drawn by a hash of the id
(all if there are fewer), and SEQUENCES stretches of LENGTH words from each.  Prediction reads whole texts.

Marginals add up to one over the languages learned, whatever the text.  So whether a text is in any of them is told by
another figure: the share of the letter triples in its words that the model knows.  One in every CALIBRATE texts of the
sample is not fitted but measured, and the floor is what all but FLOOR_SHARE of these texts reach, less FLOOR_SLACK.

Null text, or one without letters: `und`, score 0.  If no document is labelled, every text is `und`.  Of languages with equal
sums the first in the alphabet is taken.  Repeated rows get equal results; other columns are ignored; no rows: no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows

SAMPLE_DOCS = 300
SEQUENCES = 4
LENGTH = 40
SWITCHED = 0.3
EPOCHS = 40
MIN_COUNT = 3
MEMO_WORDS = 200_000
SLICE_WORDS = 250_000
CALIBRATE, FLOOR_SHARE, FLOOR_SLACK = 8, 0.01, 0.2
SURE = 4
#: What is in \w and no decimal digit, but no letter either: other numbers.
OTHER_NUMBERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isdecimal() and not unicodedata.category(c).startswith("L"))
#: Texts that may hold some: those of the basic plane by a table (which a class with any beyond wouldn't get), or any beyond.
MAY_HOLD = re.compile("[" + "".join(c for c in OTHER_NUMBERS if c < "\U00010000") + "]"), re.compile("[\U00010000-\U0010ffff]")
BLANKED = dict.fromkeys(map(ord, OTHER_NUMBERS), " ")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Affixes, letter pairs and triples, and the word itself."""
    padded = f"^{word}$"
    out = [f"={word}", *(f"<{word[:k]}" for k in (1, 2, 3)), *(f">{word[-k:]}" for k in (1, 2, 3))]
    out += [padded[i : i + 2] for i in range(len(padded) - 1)]
    return out + [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """languages, the number of each feature, weights [feature, language], transitions [from, to], and the floor: the least
    share of known letter triples of a text in one of the languages."""

    def __init__(self, languages: list[str], numbers: dict[str, int], weights: np.ndarray, transitions: np.ndarray, floor: float = 0.0):
        self.languages, self.numbers, self.weights, self.transitions, self.floor = languages, numbers, weights, transitions, floor

    def parts(self) -> tuple:
        return self.languages, self.numbers, self.weights, self.transitions, self.floor


def _flat(words: list[str], numbers: dict[str, int], measure: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the known features of words, one after another, where each word begins, and, if they are to be measured, how
    many of its letter triples (as many as it has letters) are known; feature 0 is the bias."""
    get = numbers.get
    flat, begin, triples = [], [], []
    for w in words:
        begin.append(len(flat))
        flat.append(0)
        if measure:
            found = list(map(get, features(w)))
            triples.append(len(w) - found[-len(w) :].count(None))
            flat += [n for n in found if n is not None]
        else:
            flat += [n for f in features(w) if (n := get(f)) is not None]
    return np.array(flat, dtype=np.int64), np.array(begin, dtype=np.int64), np.array(triples, dtype=np.int64)


def forward_backward(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of chains of any lengths at once.  emit: [word, label] likelihoods, chain after chain; sizes: words of each
    chain; trans: [from, to] likelihoods.  Returns the marginals, the sums of transition marginals, and log-normalizers."""
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    steps = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    first = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[order] = np.arange(len(sizes))
    at = np.arange(len(emit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = first[at] + np.repeat(rank, sizes)
    e = np.empty_like(emit)
    e[place] = emit
    alpha = np.empty_like(e)
    log_z = np.zeros(len(sizes))
    now = None
    for t in range(steps):
        a, n = first[t], active[t]
        now = e[a : a + n] if t == 0 else (now[:n] @ trans) * e[a : a + n]
        total = now.sum(axis=1)
        now = now / total[:, None]
        alpha[a : a + n] = now
        log_z[:n] += np.log(total)
    beta = np.empty_like(e)
    pairs = np.zeros_like(trans, dtype=np.float64)
    nxt = None
    for t in range(steps - 1, -1, -1):
        a, n = first[t], active[t]
        b = np.ones((n, e.shape[1]), dtype=e.dtype)
        if nxt is not None:
            m = len(nxt)
            right = nxt * e[first[t + 1] : first[t + 1] + m]
            back = right @ trans.T
            norm = (alpha[a : a + m] * back).sum(axis=1)
            pairs += trans * ((alpha[a : a + m] / norm[:, None]).T @ right)
            b[:m] = back / norm[:, None]
        beta[a : a + n] = b
        nxt = b
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    back = np.empty_like(log_z)
    back[order] = log_z
    return gamma[place], pairs, back


def fit(sequences: list[tuple[list[str], list[int]]], languages: list[str], epochs: int = EPOCHS, l2: float = 1e-6) -> Model:
    """Maximum likelihood by Adam over all sequences of (words, labels)."""
    k = len(languages)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for s, _ in sequences for w in s], dtype=np.int64)
    gold = np.array([y for _, s in sequences for y in s], dtype=np.int64)
    sizes = np.array([len(s) for s, _ in sequences], dtype=np.int64)
    times = np.bincount(ids, minlength=len(index))
    count: dict[str, int] = {}
    for w, n in zip(index, times.tolist(), strict=True):
        for f in features(w):
            count[f] = count.get(f, 0) + n
    numbers = {f: i + 1 for i, f in enumerate(f for f, n in count.items() if n >= MIN_COUNT)}
    flat, begin, _ = _flat(list(index), numbers)
    owner = np.repeat(np.arange(len(index)), np.diff(np.append(begin, len(flat))))
    w, t = np.zeros((len(numbers) + 1, k)), np.zeros((k, k))
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(ids), dtype=bool)
    inner[last] = False
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[inner], gold[np.flatnonzero(inner) + 1]), 1)
    hits = np.zeros((len(ids), k))
    hits[np.arange(len(ids)), gold] = 1
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]
    for step in range(1, epochs + 1):
        score = np.add.reduceat(w[flat], begin)
        emit = np.exp(score - score.max(axis=1, keepdims=True))
        gamma, pairs, _ = forward_backward(emit[ids], sizes, np.exp(t))
        slope = np.zeros((len(index), k))
        for y in range(k):
            slope[:, y] = np.bincount(ids, weights=gamma[:, y] - hits[:, y], minlength=len(index))
        grad_w = np.stack([np.bincount(flat, weights=slope[owner, y], minlength=len(w)) for y in range(k)], axis=1)
        for p, g, s in ((w, grad_w / len(ids) + l2 * w, state[0]), (t, (pairs - moves) / len(ids) + l2 * t, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, numbers, w.astype(np.float32), t)


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return LETTERS.findall(low.translate(BLANKED) if not low.isascii() and any(p.search(low) for p in MAY_HOLD) else low)


def training_sequences(rows: list[tuple[str, str]], languages: list[str]) -> list[tuple[list[str], list[int]]]:
    """Stretches of each (text, language), evenly spaced; every 1 / SWITCHED-th is joined to half of one of another text."""
    number = {x: i for i, x in enumerate(languages)}
    found = []
    for text, lang in rows:
        words = split_words(text)
        for i in range(SEQUENCES):
            a = i * max(0, len(words) - LENGTH) // max(1, SEQUENCES - 1)
            if words[a : a + LENGTH] and (i == 0 or len(words) > LENGTH):
                found.append((words[a : a + LENGTH], [number[lang]] * len(words[a : a + LENGTH])))
    r = np.random.default_rng(11)
    out = list(found)
    for a, b in r.integers(0, max(1, len(found)), (int(SWITCHED * len(found)), 2)).tolist():
        (x, y), (u, v) = found[a], found[b]
        out.append((x[: len(x) // 2 + 1] + u[: len(u) // 2 + 1], y[: len(x) // 2 + 1] + v[: len(u) // 2 + 1]))
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from a bounded sample of labelled rows; None if there are none.  The driver holds one count for each
    language and about sample_docs texts of each."""
    labelled = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    whole = 1 << 30
    limit = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(whole, whole * sample_docs // n))])  # noqa: E741
    picked = labelled.where(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(7)), F.lit(whole)) <= limit[F.col("l")])
    rows = sorted((r.t, r.l) for r in picked.select("t", "l").collect())
    languages = sorted({l for _, l in rows})  # noqa: E741
    measured = rows[CALIBRATE - 1 :: CALIBRATE] if len(rows) >= 20 * CALIBRATE else []
    held = set(measured)
    sequences = training_sequences([r for r in rows if r not in held], languages)
    if not sequences:
        return None
    model = fit(sequences, languages)
    shares = [known_share(split_words(t), model.numbers) for t, _ in measured]
    if shares := [x for x in shares if x is not None]:
        model.floor = max(0.0, float(np.quantile(shares, FLOOR_SHARE)) - FLOOR_SLACK)
    return model


def known_share(words: list[str], numbers: dict[str, int]) -> float | None:
    """The share of the letter triples of words that are known; None without words."""
    return float(_flat(words, numbers)[2].sum()) / sum(map(len, words)) if words else None


def labeller(shared, measure: bool) -> Callable[[list[str | None]], tuple[list[str], list[float], list, list[float]]]:
    """A function from texts to their languages, scores, shares of languages and shares of known letter triples (0 unless
    measured); shared is a broadcast of Model.parts() or None."""
    known = Model(*shared.value) if shared.value else None
    trans = np.exp(known.transitions).astype(np.float32) if known else None
    memo: dict[str, int] = {}
    table = np.zeros((0, len(known.languages) if known else 0), dtype=np.float32)
    triples = np.zeros((0, 2), dtype=np.int64)

    def sums(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] sums of marginals, and the share of known triples of each text."""
        nonlocal table, triples
        if len(memo) > MEMO_WORDS:
            memo.clear()
            table, triples = table[:0], triples[:0]
        flat = [w for t in texts for w in t]
        place = list(map(memo.get, flat))
        if None in place:
            new = list({w for w, p in zip(flat, place, strict=True) if p is None})
            parts, begin, found = _flat(new, known.numbers, measure)
            score = np.add.reduceat(known.weights[parts], begin)
            memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)])
            if measure:
                triples = np.concatenate([triples, np.stack([found, np.fromiter(map(len, new), np.int64, len(new))], axis=1)])
            place = list(map(memo.__getitem__, flat))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        at, begin = np.array(place, dtype=np.int64), np.cumsum(sizes) - sizes
        gamma, _, _ = forward_backward(np.maximum(table[at], 1e-12), sizes, trans)
        all_of = np.add.reduceat(triples[at], begin) if measure else np.array([[0, 1]] * len(texts))
        return np.add.reduceat(gamma, begin, dtype=np.float64), all_of[:, 0] / all_of[:, 1]

    def label(column: list[str | None]) -> tuple[list[str], list[float], list, list[float]]:
        lang, score, shares, shown = ["und"] * len(column), [0.0] * len(column), [None] * len(column), [0.0] * len(column)
        held, texts, n = [], [], 0

        def flush():
            if texts:
                for i, t, s, x in zip(held, texts, *sums(texts), strict=True):
                    s = s / len(t)
                    best = int(s.argmax())
                    lang[i], score[i], shares[i], shown[i] = known.languages[best], float(min(1.0, s[best])), s, float(x)
            held.clear()
            texts.clear()

        # by length, so that few slices need as many steps as the longest texts have words
        for i in sorted(range(len(column)), key=lambda i: len(column[i] or "")) if known else ():
            if words := split_words(column[i]):
                held.append(i)
                texts.append(words)
                n += len(words)
                if n >= SLICE_WORDS:
                    flush()
                    n = 0
        flush()
        return lang, score, shares, shown

    return label


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares array<double>: the mean marginal of each of the model's languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts() if model else None)

    def make():
        label = labeller(shared, measure=False)

        def step(batch: pa.RecordBatch) -> dict:
            lang, score, shares, _ = label(batch.column(1).to_pylist())
            return {id_col: batch.column(0), "lang_pred": lang, "score": score, "shares": shares}

        return step

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, shares array<double>", make)


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows of language `und`, or whose share of known letter triples is under
    the model's floor; a short text's share is given the benefit of SURE standard errors."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model.parts() if model else None), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        label = labeller(shared, measure=True)
        floor = shared.value[4] if shared.value else 0.0
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, _, _, known = label(texts)
            keep = [x != "und" and k + SURE * (floor * (1 - floor) / max(1, len(t or ""))) ** 0.5 >= floor for x, k, t in zip(lang, known, texts, strict=True)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the documents, never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
