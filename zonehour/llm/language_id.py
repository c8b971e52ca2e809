"""Language identification by error-correcting output codes.

Every learned language has a codeword. One binary classifier per bit, a logistic
one over hashed byte n-grams, predicts that bit; the language whose codeword has
the least loss, bits weighted by how well they did on rows set aside, is chosen.
Where the runner-up is about as near, the result is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import blocks

#: Buckets of hashed n-grams.
BUCKETS = 4096
#: Labelled rows that the bits are learned from at most, over all languages.
SAMPLE_ROWS = 2_400
#: Texts whose counts are held at once.
ROWS = 256
UNDETERMINED = "und"

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-byte n-grams of the lower-cased letters, a row per text."""
    raw = [x.lower().encode("utf-8", "replace").translate(_LETTERS) for x in texts]
    out = np.zeros((len(raw), BUCKETS), np.float32)
    for a, b in blocks([len(x) for x in raw], rows=ROWS):
        part = raw[a:b]
        # With blanks around each text, no n-gram reaches from one into the next.
        buf = np.frombuffer(b"".join(b" " + x + b"  " for x in part) + b"  ", np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(b - a, dtype=np.int64), [len(x) + 3 for x in part])
        n = len(row)
        blank = buf == 32
        gram = np.zeros(n, np.uint32)
        counts = np.zeros((b - a) * BUCKETS, np.int64)
        for k in range(3):
            gram = gram * np.uint32(0x01000193) + buf[k : n + k] + np.uint32(k + 1)
            use = ~(blank[:n] & blank[1 : n + 1]) if k else ~blank[:n]
            h = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
            counts += np.bincount((row * BUCKETS + h)[use], minlength=len(counts))
        counts = counts.reshape(b - a, BUCKETS)
        out[a:b] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: every split of the languages while these are few, else the best of some random codes."""
    if k <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.float32).T.reshape(k, -1)
    rng, bits = np.random.default_rng(seed), max(15, 4 * int(np.ceil(np.log2(k))) + 3)
    best, far = None, -1
    for _ in range(300):
        code = rng.choice(np.array([1, -1], np.float32), (k, bits))
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(k, dtype=bool)].min()
        if least > far and (np.abs(code.sum(axis=0)) < k).all():
            best, far = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of features the chosen language's place, its share of the belief, and the gap to the next."""
        if len(self.langs) == 1:
            n = len(x)
            return np.zeros(n, int), np.ones(n), np.ones(n)
        margin = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        order = np.sort(loss, axis=1)
        belief = np.exp(-(loss - order[:, :1]))
        belief /= belief.sum(axis=1, keepdims=True)
        top = np.sort(belief, axis=1)
        return loss.argmin(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def fit(texts: list[str], langs: list[str], steps: int = 150) -> Model:
    """Learns the bits by gradient descent; each fifth row is set aside for the bits' weights."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        z = np.zeros((BUCKETS, 0), np.float32)
        return Model(names, code, z, np.zeros(0, np.float32), np.zeros(0, np.float32))
    place = {n: i for i, n in enumerate(names)}
    y = np.array([place[x] for x in langs])
    x = features(texts)
    aside = np.arange(len(y)) % 5 == 4
    aside &= len(y) >= 20
    share = np.bincount(y, minlength=len(names))
    row_weight = (1.0 / share)[y][~aside].astype(np.float32)
    row_weight /= row_weight.sum()
    xs, ys = x[~aside], code[y[~aside]]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -ys / (1 + np.exp(np.clip(ys * (xs @ w + b), -30, 30))) * row_weight[:, None]
        vw = 0.9 * vw - 20.0 * (xs.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    held = aside if aside.any() else ~aside
    hit = (np.sign(x[held] @ w + b) == code[y[held]]).mean(axis=0)
    trust = np.maximum(2 * hit - 1, 0.05)
    return Model(names, code, w, b, (trust / trust.sum() * min(len(trust), 6)).astype(np.float32))


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from a sample of the learnable rows: per language those of the least id hashes, sample_rows in all at most, or one of each language if these are more.

    None if no row has both a text and a language.
    """
    x = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    x = x.select(F.col(lang_col).alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    langs = x.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    if not langs:
        return None
    each = max(1, sample_rows // len(langs))
    # A share of the hash's range that holds some more than `each` rows of a language; train() keeps the first of them.
    rate = {r.lang: min(1.0, (1.2 * each + 20) / r["count"]) for r in langs}
    limit = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(v * (1 << 30)))) for k, v in rate.items()))
    sample = x.where(F.pmod(F.col("h"), F.lit(1 << 30)) <= F.element_at(limit, F.col("lang"))).withColumn("h", F.pmod(F.col("h"), F.lit(1 << 30)))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "h", "text"]).groupby("lang", sort=True).head(each)
        part = part.sort_values(["h", "lang", "text"])
        m = fit(part["text"].tolist(), part["lang"].tolist())
        return pd.DataFrame({"langs": [m.langs], **{k: [getattr(m, k).astype(np.float32).tobytes()] for k in ("code", "weights", "bias", "trust")}})

    r = sample.groupBy().applyInPandas(train, "langs array<string>, code binary, weights binary, bias binary, trust binary").first()
    n = len(r.langs)
    array = lambda v: np.frombuffer(v, np.float32)
    bits = len(array(r.bias))
    return Model(list(r.langs), array(r.code).reshape(n, -1), array(r.weights).reshape(BUCKETS, bits), array(r.bias), array(r.trust))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous_gap: float = 0.2) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; columns of these names give way.

    A text that is null or has no letter is `und` with score 0, not ambiguous;
    so is every text if nothing could be learned. Of languages that are equally
    near, the first by name is taken. Whole texts are used, however long; repeated
    rows have a result each, an empty table gives an empty one; all other columns
    are only passed on.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            use = b.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            texts = b.column(kept.index(text_col)).filter(pa.array(use)).to_pylist()
            pick, score, gap = (np.empty(len(texts), t) for t in (int, float, float))
            for i, j in blocks([len(t) for t in texts], rows=ROWS):
                pick[i:j], score[i:j], gap[i:j] = model.decode(features(texts[i:j]))
            lang = np.full(b.num_rows, UNDETERMINED, object)
            lang[use] = np.array(model.langs, object)[pick]
            full, near = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            full[use], near[use] = np.clip(score, 0, 1), gap < ambiguous_gap
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(full), pa.array(near)], [*kept, "lang_pred", "score", "ambiguous"])

    if model is None:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    out = schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters")).mapInArrow(run, out)
