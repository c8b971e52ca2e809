"""Perplexity by an interpolated modified Kneser-Ney bigram model.

Counting: tasks sum the word pairs of their documents and send them, packed, to
the shard of the pair's hash, so that no word makes a shard large. A shard adds
up its pairs, writes them as sorted hash arrays and sends what each word has
gathered there, as first and as second of a pair, to that word's shard, which
adds up and writes the words. Shards are as many as the bytes of text ask for.
Only the counts of counts, a few numbers a shard, come to the driver.

Scoring: workers map the arrays into memory and look up sorted hashes, so a
worker holds what it touches and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.llm.arrays import get, get_counts, put, put_counts
from zonehour.llm.common import Words, blocks, mix64, new_path, text_bytes

#: Hashes that stand for the end and the start of a text.
END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
#: Word pairs that a task gathers before it sends them, and bytes of text scored at once.
GATHERED, SCORED_BYTES = 3_000_000, 6 << 20
#: Bytes of text that a shard of pairs stands for, shards at least and most, and shards of pairs for one of words.
SHARD_BYTES, SHARDS, PAIRS_A_WORD = 16 << 20, (8, 1 << 20), 8


# --- tokens ------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of the lower-cased texts: the token before it, itself, and where each text's tokens begin."""
    words = Words([t.lower() for t in texts])
    n = np.diff(words.first) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    now = np.full(first[-1], END)
    now[np.arange(len(words.hash)) + np.repeat(np.arange(len(texts)), n - 1)] = words.hash
    before = np.concatenate([[START], now[:-1]]) if len(now) else now
    before[first[:-1]] = START
    return before, now, first


def pair_key(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) * np.uint64(5) + now)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By the leading 32 bits, so that sorted keys are sorted by shard."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * (1 + len(kinds)), []
    for k, n in zip(kinds, np.frombuffer(raw, np.int64, len(kinds), 8), strict=True):
        out.append(np.frombuffer(raw[at : at + n], k))
        at += int(n)
    return out


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, a place of each in the input, and the values' sums."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], order[first], [np.add.reduceat(v[order], first) if len(s) else v for v in values]


# --- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and what the corpus has as a whole."""

    folder: str
    shards: int
    word_shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float

    def find(self, kind: str, key: np.ndarray, shards: int, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
        """The counts of sorted keys, 0 for those that the corpus lacks."""
        out = {f: np.zeros(len(key), np.int64) for f in fields}
        if not len(key):
            return out
        at = shard_of(key, shards)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = int(at[a])
            keys = get(self.folder, f"{kind}-{s}-key", "u8")
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, key[a:b]), len(keys) - 1)
            hit = keys[place] == key[a:b]
            for f in fields:
                out[f][a:b][hit] = get_counts(self.folder, f"{kind}-{s}-{f}", len(keys))[place[hit]]
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score."""
        before, now, first = tokens(texts)
        word, word_at = np.unique(now, return_inverse=True)
        w = self.find("word", word, self.word_shards, ("count", "after"))
        c = w["count"].astype(np.float64)
        base = np.log10((c + 1) / (self.tokens + 1 * (self.words + 1)))
        d = np.array([0.0, *self.word_discounts])[np.minimum(w["after"], 3)]
        low = (np.maximum(w["after"] - d, 0) / max(self.pairs, 1) + self.word_rest / (self.words + 1))[word_at]
        ctx, ctx_at = np.unique(before, return_inverse=True)
        x = self.find("context", ctx, self.word_shards, ("count", "n1", "n2", "n3"))
        rest = sum(k * x[f] for k, f in zip(self.pair_discounts, ("n1", "n2", "n3"), strict=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(x["count"] > 0, rest / x["count"], 1.0)[ctx_at]
        total = np.maximum(x["count"], 1)[ctx_at].astype(np.float64)
        key, at = np.unique(pair_key(before, now), return_inverse=True)
        n = self.find("pair", key, self.shards, ("count",))["count"]
        n = (n - np.array([0.0, *self.pair_discounts])[np.minimum(n, 3)])[at]
        p = np.log10(np.maximum(n, 0) / total + rest * low)
        run = lambda v: (s := np.concatenate([[0.0], np.cumsum(v)]))[first[1:]] - s[first[:-1]]
        return np.diff(first), run((c > 0)[word_at]).round().astype(np.int64), run(base[word_at]), run(p)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's from counts of counts; where these are too few, the usual halves."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(x, 0.05), k - 0.05)) for x, k in zip(d, (1, 2, 3), strict=True))


def count_model(docs: DataFrame, text_col: str = "text", shards: int | None = None) -> Model:
    """Counts all texts of docs (null: empty, just an end) into a model in the shared folder."""
    spark = docs.sparkSession
    folder = new_path(spark, "lm")
    size = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    shards = shards or min(SHARDS[1], max(SHARDS[0], -(-size // SHARD_BYTES)))
    word_shards = max(1, min(4096, shards // PAIRS_A_WORD))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            before, now, count = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            key, one, (count,) = _summed(pair_key(before, now), count)
            before, now = before[one], now[one]
            s = shard_of(key, shards)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
            for part in range(0, len(cut) - 1, 256):
                out = []
                for a, b in zip(cut[part : part + 256], cut[part + 1 : part + 257], strict=False):
                    # Words are sent once, pairs as their places, those of the first word as steps.
                    word, at = np.unique(np.concatenate([before[a:b], now[a:b]]), return_inverse=True)
                    x, y = at[: b - a], at[b - a :]
                    order = np.lexsort((y, x))
                    out.append(_pack(word, np.diff(x[order], prepend=0).astype(np.uint32), y[order].astype(np.uint32), count[a:b][order]))
                yield pa.RecordBatch.from_arrays([pa.array(s[cut[part : part + len(out)]], pa.int32()), pa.array(out, pa.binary())], ["shard", "blob"])

        for b in batches:
            texts = text_bytes(b.column(0))
            for i, j in blocks([len(t) for t in texts]):
                before, now, _ = tokens(texts[i:j])
                _, one, (count,) = _summed(pair_key(before, now), np.ones(len(now), np.int64))
                held.append((before[one], now[one], count))
                n += len(one)
                if n > GATHERED:
                    yield from send()
                    n = 0
        if n:
            yield from send()

    def pairs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """A shard's pairs are written; what each word gains goes on to its own shard."""
        got = [_unpack(x, "u8", "u4", "u4", "i8") for x in part["blob"]]
        before = np.concatenate([g[0][np.cumsum(g[1])] for g in got])
        now, count = np.concatenate([g[0][g[2]] for g in got]), np.concatenate([g[3] for g in got])
        k, one, (count,) = _summed(pair_key(before, now), count)
        before, now = before[one], now[one]
        s = int(key[0])
        put(folder, f"pair-{s}-key", k), put_counts(folder, f"pair-{s}-count", count)
        ctx, _, sums = _summed(before, count, *((count == x).astype(np.int64) for x in (1, 2)), (count > 2).astype(np.int64))
        w, _, gains = _summed(now, count, np.ones(len(now), np.int64))
        at, to = shard_of(ctx, word_shards), shard_of(w, word_shards)
        rows = []
        for z in np.union1d(at, to).tolist():
            a, b, c, d = np.searchsorted(at, z), np.searchsorted(at, z, "right"), np.searchsorted(to, z), np.searchsorted(to, z, "right")
            rows.append((z, _pack(w[c:d], *(v[c:d] for v in gains), ctx[a:b], *(v[a:b] for v in sums))))
        out = pd.DataFrame(rows, columns=["shard", "blob"]).astype({"shard": np.int32})
        for x in (1, 2, 3, 4):
            out[f"p{x}"] = np.where(np.arange(len(out)) == 0, int((count == x).sum()), 0)
        return out

    def words(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(x, "u8", "i8", "i8", "u8", "i8", "i8", "i8", "i8") for x in part["blob"]]
        every = [np.concatenate([g[k] for g in got]) for k in range(8)]
        w, _, (count, after) = _summed(every[0], *every[1:3])
        ctx, _, sums = _summed(every[3], *every[4:])
        s = int(key[0])
        put(folder, f"word-{s}-key", w), put_counts(folder, f"word-{s}-count", count), put_counts(folder, f"word-{s}-after", after)
        put(folder, f"context-{s}-key", ctx)
        for f, v in zip(("count", "n1", "n2", "n3"), sums, strict=True):
            put_counts(folder, f"context-{s}-{f}", v)
        row = {"shard": s, "words": len(w), "tokens": int(count.sum()), "pairs": int(after.sum())}
        row |= {f"p{x}": int(part[f"p{x}"].sum()) for x in (1, 2, 3, 4)} | {f"w{x}": int((after == x).sum()) for x in (1, 2, 3, 4)}
        return pd.DataFrame([row])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "shard int, blob binary")
    # A partition is a shard, so that a task's part stays as large as one.
    def whole(write):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(parts)
            part = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"shard": []})
            for s in sorted(set(part["shard"])):
                yield write((s,), part[part["shard"] == s])

        return run

    gains = sent.repartitionById(shards, F.col("shard")).mapInPandas(whole(pairs), "shard int, blob binary, p1 long, p2 long, p3 long, p4 long")
    names = ["words", "tokens", "pairs", *(f"{x}{k}" for x in "pw" for k in (1, 2, 3, 4))]
    found = gains.repartitionById(word_shards, F.col("shard")).mapInPandas(whole(words), "shard int, " + ", ".join(f"{n} long" for n in names))
    total = {n: v or 0 for n, v in found.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}
    wd = discounts(*(total[f"w{k}"] for k in (1, 2, 3, 4)))
    more = total["words"] - total["w1"] - total["w2"]
    rest = (wd[0] * total["w1"] + wd[1] * total["w2"] + wd[2] * more) / total["pairs"] if total["pairs"] else 1.0
    return Model(folder, shards, word_shards, total["tokens"], total["words"], total["pairs"], discounts(*(total[f"p{k}"] for k in (1, 2, 3, 4))), wd, rest)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Scores are log10 probabilities of the whole lower-cased text and its end. A
    null text counts as empty: its end alone. Other columns are ignored,
    repeated rows give repeated results, an empty table an empty one. A very long
    text is scored as a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            parts = [model.score(texts[i:j]) for i, j in blocks([len(t) for t in texts], SCORED_BYTES)]
            cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_tokens", "n_known", "base_score", "score"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    x = x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return x.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_held_out(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the learnable rows and scores all."""
    return score_texts(docs, count_model(docs.where(learnable), text_col), id_col, text_col)
