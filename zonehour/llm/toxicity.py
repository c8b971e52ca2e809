"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from the labelled sample: words, and beginnings of words,
that toxic documents have more often than others, beyond chance. The features of
a document are densities of the lexicon's words (plain, by their beginning,
hidden by look-alike characters or spelled out), how near they are to the second
person, and rates of capitals, punctuation and obfuscation. Shallow trees on
histograms are boosted on the logistic loss. Lexicon and trees that judge a
labelled row for calibration have not seen it: the sample is dealt into folds.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import blocks, mix64, text_bytes

#: Labelled rows that lexicon and trees are learned from at most.
SAMPLE_ROWS = 8_000
#: Folds of the sample; trees, their depth, step and ridge; bins of a feature.
FOLDS, TREES, DEPTH, STEP, RIDGE, BINS = 5, 80, 3, 0.15, 2.0, 64
#: Bytes of the beginnings of words that the lexicon may hold.
STEMS = (4, 5, 6)
#: A lexicon's entry has log odds of LEAST_ODDS or more, SURE standard errors below the estimate.
LEAST_ODDS, SURE = 1.5, 2.0

# The second person in some languages, and characters that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo tuya"
LOOKALIKES = str.maketrans("0134578@$!|€+", "oieastbasiiet")

FEATURES = (
    "log_words", "word_density", "stem_density", "hidden_density", "word_hits", "stem_hits", "hidden_hits", "most_odds", "odds_per_word",
    "you_density", "near_you", "capitals", "shouted", "loud_marks", "other_marks", "obfuscated", "stretched", "alone",
)

_LETTERS = re.compile(r"[^\W\d_]+")
_HELD = re.compile(r"([^\W\d_])\1\1+")


def unhidden(word: str) -> str:
    """A word as it reads: look-alikes as letters, letters held three times and more as one, marks left out."""
    return "".join(_LETTERS.findall(_HELD.sub(r"\1", word.strip("\"'`.,;:!?()[]{}<>…«»„“”‚‘’").lower().translate(LOOKALIKES))))


# --- bytes of texts ------------------------------------------------------------

_SPACE, _LOW, _UP, _DIGIT, _LOUD, _HIDE, _MARK = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = _LOW
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = _UP
_KIND[np.frombuffer(b"0123456789", np.uint8)] = _DIGIT
_KIND[np.frombuffer(b"!?", np.uint8)] = _LOUD
_KIND[np.frombuffer(b"@$|*+", np.uint8)] = _HIDE
_KIND[128:] = _LOW
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_STEM_MARK = np.uint64(0xA5A5A5A5A5A5A5A5)


class _Bytes:
    """Texts as one array of bytes: their kinds and lower case, tokens (runs of letters and digits) and words (between white space)."""

    def __init__(self, texts: Sequence[bytes]):
        self.raw = b" ".join(texts) + b"  "
        buf = np.frombuffer(self.raw, np.uint8)
        self.at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind, low = _KIND[buf], buf.copy()
        low[kind == _UP] += 32
        if buf.max(initial=0) > 127:
            nxt = buf[1:]
            big = (buf[:-1] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)  # capitals of Latin-1
            low[1:][big] += 32
            kind[:-1][big] = _UP
            quote = np.flatnonzero((buf[:-1] == 0xE2) & (nxt == 0x80))  # typographic marks
            kind[quote], kind[quote + 1], kind[np.minimum(quote + 2, len(kind) - 1)] = _MARK, _MARK, _MARK
            kind[np.flatnonzero((buf[:-1] == 0xC2) & (nxt <= 0xBF)) + np.array([[0], [1]])] = _MARK
        self.kind, self.low, self.buf = kind, low, buf
        self.letter = (kind == _LOW) | (kind == _UP)
        self.first = buf & 0xC0 != 0x80  # not the rest of a character
        inside = np.concatenate([[False], self.letter | (kind == _DIGIT)])
        self.start, self.end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        gap = np.concatenate([[True], kind == _SPACE])
        self.word = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.word_end = np.flatnonzero(~gap[:-1] & gap[1:])
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        n = int((self.end - self.start).max(initial=1))
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        place = np.arange(len(buf)) - np.repeat(np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(buf)]])))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SPREAD[low] * power[np.minimum(place, n - 1)], dtype=np.uint64)])

    def hashes(self) -> np.ndarray:
        return mix64(self.sum[self.end] - self.sum[self.start])

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens longer than n bytes, and the hashes of their beginnings."""
        k = np.flatnonzero(self.end - self.start > n)
        return k, mix64((self.sum[self.start[k] + n] - self.sum[self.start[k]]) ^ _STEM_MARK)

    def total(self, flag: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return run[self.at[1:]] - run[self.at[:-1]]

    def words_at(self, flag: np.ndarray) -> np.ndarray:
        """The words with a flagged byte."""
        return np.unique(np.searchsorted(self.word, np.flatnonzero(flag), "right") - 1)


def _hash_of(words: Sequence[str]) -> np.ndarray:
    """Hashes of single tokens."""
    b = _Bytes([w.encode() for w in words])
    out = np.zeros(len(words), np.uint64)
    out[b.doc] = b.hashes()
    return out


def terms(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the distinct tokens of each text and their beginnings, as hashes."""
    b = _Bytes(texts)
    doc, term = [b.doc], [b.hashes()]
    for n in STEMS:
        k, h = b.stems(n)
        doc.append(b.doc[k])
        term.append(h)
    doc, term = np.concatenate(doc), np.concatenate(term)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.append(True, (np.diff(doc) != 0) | (term[1:] != term[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], term[new]


@dataclass
class Lexicon:
    """Hashes of terms, ascending, and their log odds; an unknown term has none."""

    term: np.ndarray
    odds: np.ndarray

    @staticmethod
    def of(entries: dict[str, float]) -> Lexicon:
        """From words, and beginnings of words marked by a ^."""
        h = _hash_of([w.lstrip("^") for w in entries])
        for i, w in enumerate(entries):
            if w[0] == "^":
                h[i] = _Bytes([(w[1:] + "-").encode().replace(b"-", b"x")]).stems(len(w[1:].encode()))[1][0]
        order = np.argsort(h)
        return Lexicon(h[order], np.array(list(entries.values()), np.float64)[order])

    def look(self, h: np.ndarray) -> np.ndarray:
        if not len(self.term):
            return np.zeros(len(h))
        k = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        return np.where(self.term[k] == h, self.odds[k], 0.0)

    def look_words(self, words: Sequence[str]) -> np.ndarray:
        """The log odds of single words, as such or by their beginnings."""
        b = _Bytes([w.encode() for w in words])
        odds = np.zeros(len(words))
        np.maximum.at(odds, b.doc, self.look(b.hashes()))
        for n in STEMS:
            k, h = b.stems(n)
            np.maximum.at(odds, b.doc[k], self.look(h))
        return odds


def learn_lexicon(docs: np.ndarray, terms: np.ndarray, labels: np.ndarray) -> Lexicon:
    """The terms that texts of label 1 have beyond chance: (docs, terms) as `terms` gives them, labels of the texts that count, -1 of others."""
    y = labels[docs]
    n = [int((labels == label).sum()) for label in (0, 1)]
    found, a = np.unique(terms[y == 1], return_counts=True)
    k = np.searchsorted(found, t0 := terms[y == 0])
    same = np.append(found, 0)[k] == t0 if len(found) else np.zeros(len(t0), bool)
    same &= k < len(found)
    b = np.bincount(k[same], minlength=len(found))
    a, b = a + 0.5, b + 0.5
    odds = np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1))
    keep = odds - SURE * np.sqrt(1 / a + 1 / b) >= LEAST_ODDS
    return Lexicon(found[keep], odds[keep])


# --- features -------------------------------------------------------------------

_YOU = np.sort(_hash_of(SECOND_PERSON.split()))


def _features(lexicon: Lexicon, texts: Sequence[bytes]) -> np.ndarray:
    b = _Bytes(texts)
    h, n_texts = b.hashes(), len(texts)
    per_text = lambda doc, w=None: np.bincount(doc, w, n_texts)
    plain, stem = lexicon.look(h), np.zeros(len(h))
    for n in STEMS:
        k, s = b.stems(n)
        stem[k] = np.maximum(stem[k], lexicon.look(s))
    you = _YOU[np.minimum(np.searchsorted(_YOU, h), len(_YOU) - 1)] == h

    # Words that may hide another: letters beside digits or look-alikes, or held.
    kind, letter = b.kind, b.letter
    digit, hide = kind == _DIGIT, (kind == _HIDE) | (b.buf == 33)
    mixed = np.zeros(len(kind), bool)
    mixed[:-1] = (letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:]) | (hide[:-1] & (letter | digit)[1:])
    held = np.zeros(len(kind), bool)
    held[:-2] = letter[:-2] & (b.low[:-2] == b.low[1:-1]) & (b.low[:-2] == b.low[2:])
    odd, stretched = b.words_at(mixed), b.words_at(held)
    hidden, most = np.zeros(n_texts), np.zeros(n_texts)
    suspects = np.union1d(odd, stretched)
    if len(suspects):
        raw = [b.raw[b.word[w] : b.word_end[w]].decode("utf-8", "replace") for w in suspects]
        read = [unhidden(w) for w in raw]
        odds = np.where([r != w.lower() for r, w in zip(read, raw, strict=True)], lexicon.look_words(read), 0.0)
        owner = np.searchsorted(b.at, b.word[suspects], "right") - 1
        hidden += per_text(owner, odds > 0)
        np.maximum.at(most, owner, odds)

    # Letters alone in a row may spell a word.
    size = np.concatenate([[0], np.cumsum(b.first)])
    alone = (size[b.end] - size[b.start] == 1) & letter[b.start]
    k = np.flatnonzero(alone)
    if len(k):
        cut = np.flatnonzero(np.append(True, (np.diff(k) != 1) | (np.diff(b.doc[k]) != 0)))
        long = np.diff(np.append(cut, len(k))) > 2
        runs = [(k[i], k[j - 1]) for i, j in zip(cut[long], np.append(cut[1:], len(k))[long], strict=True)]
        if runs:
            said = ["".join(b.raw[b.start[t] : b.end[t]].decode("utf-8", "replace") for t in range(i, j + 1)).lower() for i, j in runs]
            odds, owner = lexicon.look_words(said), b.doc[[i for i, _ in runs]]
            hidden += per_text(owner, odds > 0)
            np.maximum.at(most, owner, odds)

    odds = np.maximum(plain, stem)
    np.maximum.at(most, b.doc, odds)
    near = np.zeros(len(h))
    yous, hits = np.flatnonzero(you), np.flatnonzero(odds > 0)
    if len(yous) and len(hits):
        k = np.searchsorted(yous, hits)
        for other in (yous[np.minimum(k, len(yous) - 1)], yous[np.maximum(k - 1, 0)]):
            near[hits] = np.maximum(near[hits], np.where(b.doc[other] == b.doc[hits], 1 / (1.0 + np.abs(other - hits)), 0))
    upper = np.concatenate([[0], np.cumsum(b.first & (kind == _UP))])
    shouted = (size[b.end] - size[b.start] > 2) & (upper[b.end] - upper[b.start] == size[b.end] - size[b.start])
    n_words = per_text(np.searchsorted(b.at, b.word, "right") - 1)
    n, n_letters = np.maximum(n_words, 1), np.maximum(b.total(letter & b.first), 1)
    word, stems = per_text(b.doc, plain > 0), per_text(b.doc, stem > 0)
    of_words = lambda w: per_text(np.searchsorted(b.at, b.word[w], "right") - 1)
    return np.column_stack([
        np.log1p(n_words), word / n, stems / n, hidden / n, np.log1p(word), np.log1p(stems), np.log1p(hidden), most, per_text(b.doc, odds) / n,
        per_text(b.doc, you) / n, per_text(b.doc, near) / n, b.total(b.first & (kind == _UP)) / n_letters, per_text(b.doc, shouted) / n, b.total(kind == _LOUD) / n,
        b.total(b.first & ((kind == _MARK) | (kind == _HIDE))) / n, of_words(odd) / n, of_words(stretched) / n, per_text(b.doc, alone) / n,
    ])


def features(lexicon: Lexicon, texts: Sequence[bytes]) -> np.ndarray:
    """A row of FEATURES per text; of an empty one all are zero. Texts are read whole, a block at a time."""
    parts = [_features(lexicon, texts[a:b]) for a, b in blocks([len(t) for t in texts])]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


# --- trees ----------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of one depth: node k has the children 2k + 1 and 2k + 2, right if a feature is above its threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            k = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                k = 2 * k + 1 + (x[row, f[k]] > t[k])
            out += leaf[k - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees on histograms, by gradients and curvatures of the logistic loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Zeros are many in rates; a cut right above the commonest value keeps rare ones apart from it.
    edges = [np.unique(np.append(e, [np.median(c), c.min(initial=0)])) for e, c in zip(edges, x.T, strict=True)]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    width, inner = BINS + 4, 2**DEPTH - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    margin = np.full(len(y), base)
    flat = bins + width * np.arange(x.shape[1])
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base_node = 2**level - 1
            for k in range(base_node, 2 * base_node + 1):
                mine = np.flatnonzero(node == k)
                where = flat[mine].ravel()
                G, H = (np.bincount(where, np.repeat(v[mine], x.shape[1]), width * x.shape[1]).reshape(-1, width) for v in (g, h))
                GL, HL = G.cumsum(axis=1), H.cumsum(axis=1)
                GR, HR = GL[:, -1:] - GL, HL[:, -1:] - HL
                gain = GL**2 / (HL + RIDGE) + GR**2 / (HR + RIDGE) - GL[:, -1:] ** 2 / (HL[:, -1:] + RIDGE)
                gain[(HL < 0.5) | (HR < 0.5)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, k], out.threshold[t, k] = f, edges[f][b]
                    node[mine] = 2 * k + 1 + (bins[mine, f] > b)
                else:
                    node[mine] = 2 * k + 1
        leaf = node - inner
        value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        out.leaf[t] = STEP * value
        margin += out.leaf[t][leaf]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing step function closest to y over x: where its steps begin and end, and their values."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    sums, n = np.add.reduceat(y[order].astype(float), start), np.diff(np.append(start, len(x)))
    pools: list[list[float]] = []  # first, last, sum, count
    for at, s, c in zip(xs.tolist(), sums.tolist(), n.tolist(), strict=True):
        pools.append([at, at, s, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, s2, c2 = pools.pop()
            pools[-1][1:] = [last, pools[-1][2] + s2, pools[-1][3] + c2]
    return np.array([v for p in pools for v in p[:2]]), np.array([v for p in pools for v in (p[2] / p[3],) * 2])


@dataclass
class Model:
    """prior alone judges where there was nothing to learn from."""

    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.margin(features(self.lexicon, texts)), *self.steps)


def fit(texts: Sequence[bytes], labels: np.ndarray, folds: int = FOLDS) -> Model:
    """Lexicon, trees and calibration. The texts are dealt into folds in turn; without both labels outside each of them, the prior judges."""
    y = np.asarray(labels).astype(int)
    fold = np.arange(len(y)) % folds
    prior = float((y.sum() + 1) / (len(y) + 2))
    if any(len(np.unique(y[fold != k])) < 2 for k in range(folds)):
        return Model(Lexicon.of({}), None, (np.zeros(1), np.zeros(1)), prior)
    found = [(doc + a, term) for a, b in blocks([len(t) for t in texts]) for doc, term in [terms(texts[a:b])]]
    doc, term = (np.concatenate(x) for x in zip(*found, strict=True))
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        mine = np.flatnonzero(fold == k)
        x[mine] = features(learn_lexicon(doc, term, np.where(fold == k, -1, y)), [texts[i] for i in mine])
    unseen = np.zeros(len(y))
    for k in range(folds):
        unseen[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(doc, term, y), boost(x, y), isotonic(unseen, y), prior)


def sample(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(h, id, label, text) of learnable labelled rows by the least id hashes, one per id, `rows` at most.

    An id with both labels counts as label 1, one with several texts by the least of them.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    picked = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = picked.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"), F.first(h).alias("h")).orderBy("h", "id").limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return F.broadcast(picked).join(texts, "id").groupBy("h", "id", "label").agg(F.min("text").alias("text"))  # picked is `rows` short rows at most


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the sample of labelled rows. Null ids, labels and texts teach nothing; without both labels every text scores their share."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id"])
        return pd.DataFrame({"model": [pickle.dumps(fit(part["text"].tolist(), part["label"].to_numpy()))]})

    rows = sample(docs, labels, learnable, id_col, text_col, label_col, sample_rows)
    r = rows.groupBy().applyInPandas(train, "model binary").first()
    return pickle.loads(bytes(r.model)) if r else fit([], np.zeros(0))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row: score is the calibrated belief in label 1, predicted whether it reaches the threshold.

    A null text counts as empty; an empty one has all features zero and the score
    of that. Repeated rows have a result each, null ids stay, an empty table gives an
    empty one, very long texts are read whole, other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts).astype(float))], ["id", "score"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    x = x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double")
    return x.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
