"""Benchmark decontamination under edit distance, by CGK embedding and bit-sampling LSH.

Texts and items are words, lower-cased and without punctuation. A CGK random
walk embeds windows and items so that few edits become few differing places.
Sampled places of a walk are the key of a table; the tables of all items are one
sorted array of keys, and the windows of each item's size that begin at every
word of a text are looked up in it. Enough walks and tables are used to reach
the target recall. What is found is verified by exact edit distance, free at
both ends.

Only windows that can hold a match are embedded: within the edits allowed, an
item of n words keeps n - 1 - 2 * edits of its word pairs and n - 2 - 3 * edits
of its triples, so that a stretch with fewer of the benchmark's has none. That
check loses no match and knows neither the item nor the place, which the tables
find.

A walk through many words with many edits falls out of step for good, and the longer
the item, the likelier. So the window of an item of more than PIECE words is walked in pieces, each by walks of its own
and all of about one size: a match of the whole has a piece with no more than its share of the edits, and is found
as surely as a short item. Pieces of one size are embedded once for all items.

The benchmark is dealt out to shards of ITEM_BYTES, each written as arrays to the
shared folder by a task of its own and mapped by the workers, so that documents
are read once, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from zonehour.llm.arrays import get, put
from zonehour.llm.common import Words, blocks, gram_hash, mix64, new_path

#: Walks, tables of each, and sampled places of a table.
WALKS, TABLES, PLACES = 8, 5, 2
#: Words of an item from which on its window is walked in pieces.
PIECE = 128
#: Bytes of items of a shard, on average, and windows that are embedded at once.
ITEM_BYTES, EMBEDDED = 8 << 20, 2048
#: Sizes that one look for possible windows stands for, as a factor.
CLASS = 1.3

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_CLEAN)


@dataclass
class Hit:
    doc: int
    item: int
    start: int
    end: int
    edits: int


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of the text, and the end of the first such stretch."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def edits_allowed(size: np.ndarray | int, similarity: float) -> np.ndarray:
    return np.floor(np.asarray(size) * (1 - similarity) + 1e-9).astype(np.int64)


def pieces(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, offset, words) of the pieces that items of these sizes are walked in: one of a short item, some of equal size of a long one."""
    n = -(-size // PIECE)
    item = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    return item, k * size[item] // np.maximum(n[item], 1), size[item] // np.maximum(n[item], 1)


@lru_cache(4096)
def _sampled(size: int) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Which tables of which walks sample a step. Walks through `size` words take some two steps a word; the last ones, most often out of step, are not sampled."""
    u = mix64(np.arange(1, WALKS * TABLES * PLACES + 1, dtype=np.uint64) * _ODD).astype(np.float64) / 2.0**64
    step = np.sort((u.reshape(WALKS, TABLES, PLACES) * 1.5 * size).astype(np.int64), axis=2)
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for p in range(PLACES):
        for j in np.unique(step[:, :, p]).tolist():
            out.setdefault(j, []).append(np.nonzero(step[:, :, p] == j))
    return out


def embedded(words: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Keys, WALKS * TABLES a row, of the windows words[start:end], compared with items of `size` words.

    A walk stays on its word or goes on to the next as a coin says that depends
    on the step and the word; it gives the word that it was on. Memory is that of
    the keys.
    """
    place = np.repeat(start.astype(np.int64)[:, None], WALKS, axis=1)
    key = np.full((len(start), WALKS, TABLES), size, np.uint64) + np.arange(WALKS * TABLES, dtype=np.uint64).reshape(WALKS, TABLES) * np.uint64(1 << 32)
    picks = _sampled(size)
    walk = np.arange(1, WALKS + 1, dtype=np.uint64) << np.uint64(32)
    for j in range(max(picks) + 1):
        word = words.take(place, mode="clip") * (place < end[:, None])
        for w, t in picks.get(j, ()):
            key[:, w, t] = mix64(key[:, w, t] * np.uint64(3) + word[:, w])
        # Words are hashes, so that the top bit of a product is as good a coin as any.
        place += ((word * (mix64(walk + np.uint64(j)) | np.uint64(1))) >> np.uint64(63)).view(np.int64)
    return key.reshape(len(start), -1)


# --- the index ---------------------------------------------------------------


def _write(folder: str, shard: int, texts: list[str]) -> None:
    """A shard's arrays: words of the items, sorted pairs of words, and sorted keys with the item of each."""
    words = Words([normal(t) for t in texts])
    size = np.diff(words.first)
    h = words.hash
    owner = np.repeat(np.arange(len(texts)), size)
    within = lambda n: np.unique(gram_hash(h, n)[owner[: len(h) - n + 1] == owner[n - 1 :]]) if len(h) >= n else h[:0]
    pairs = np.unique(np.concatenate([within(2), mix64(h[words.first[:-1][size == 1]])]))
    keys, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    item, offset, length = pieces(size)
    begin = words.first[item] + offset
    for m in np.unique(length).tolist():
        of = np.flatnonzero(length == m)
        for a in range(0, len(of), EMBEDDED):
            k = embedded(h, begin[of[a : a + EMBEDDED]], begin[of[a : a + EMBEDDED]] + m, m)
            keys.append(k.ravel()), items.append(np.repeat(of[a : a + EMBEDDED], k.shape[1]).astype(np.uint32))
    key, piece = np.concatenate(keys), np.concatenate(items)
    order = np.argsort(key, kind="stable")
    put(folder, f"{shard}-word", h), put(folder, f"{shard}-first", words.first.astype(np.int64)), put(folder, f"{shard}-pair", pairs), put(folder, f"{shard}-triple", within(3))
    put(folder, f"{shard}-key", key[order]), put(folder, f"{shard}-piece", piece[order])


@dataclass(frozen=True)
class Index:
    """Where the shards' arrays are."""

    folder: str
    shards: int
    similarity: float

    def ids(self, shard: int) -> pa.Array:
        return pa.ipc.open_stream(get(self.folder, f"{shard}-ids", "u1").tobytes()).read_all().column(0).combine_chunks()

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, list[Hit]]]:
        """(shard, the best stretch of each text for each item that it matches); texts as normal() gives them."""
        words = Words(texts)
        if not len(words.hash):
            return
        for s in range(self.shards):
            first = get(self.folder, f"{s}-first", "i8")
            if len(first) > 1 and (found := self._hits(s, first, words)):
                yield s, found

    def _hits(self, s: int, first: np.ndarray, words: Words) -> list[Hit]:
        h, size = words.hash, np.diff(first)
        sizes = np.unique(pieces(size)[2])
        if not len(sizes):
            return []
        pair, key, piece_of = get(self.folder, f"{s}-pair", "u8"), get(self.folder, f"{s}-key", "u8"), get(self.folder, f"{s}-piece", "u4")
        doc_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        end = words.first[1:][doc_of]
        place = np.arange(len(h))
        known = {}
        for n, grams in ((2, pair), (3, get(self.folder, f"{s}-triple", "u8"))):
            g = gram_hash(h, n)
            known[n] = np.zeros(len(h) + 1, np.int64)
            known[n][1 : len(g) + 1] = np.cumsum(_within(g, grams) & (place[: len(g)] + n - 1 < end[: len(g)]))
            known[n][len(g) + 1 :] = known[n][len(g)]
        alone = _within(mix64(h), pair) if sizes[0] == 1 else None
        out: dict[tuple[int, int], Hit] = {}
        lo = 0
        while lo < len(sizes):
            hi = int(np.searchsorted(sizes, max(int(sizes[lo] * CLASS), int(sizes[lo])), "right"))
            some = self._possible(known, place, end, int(sizes[lo]), int(sizes[hi - 1]))
            for m in sizes[lo:hi].tolist():
                start = np.flatnonzero(alone) if m == 1 else some[self._possible(known, some, end[some], m, m, True)]
                self._look_up(words, doc_of, start, np.minimum(start + m, end[start]), m, key, piece_of, s, first, out)
            lo = hi
        return sorted(out.values(), key=lambda x: (x.doc, x.item))

    def _possible(self, known: dict, place, end, least: int, most: int, mask: bool = False) -> np.ndarray:
        """Places where a window of an item of `least` to `most` words may begin that has a match: enough pairs and triples are near."""
        size = np.arange(least, most + 1)
        # A piece of a long item stands for up to a word more than it has.
        k = edits_allowed(size + (size > PIECE // 2), self.similarity)
        ok = place + least - int(k[-1]) <= end
        lo, hi = place, np.minimum(place + most + int(k[-1]), end)
        for n, count in known.items():
            need = int((size - n + 1 - n * k).min())
            if need > 0 and most >= n:
                ok &= count[np.maximum(hi - n + 1, lo)] - count[lo] >= need
        return ok if mask else place[ok]

    def _look_up(self, words: Words, doc_of, start, end, m: int, key, piece_of, s: int, first, out: dict) -> None:
        h, size = words.hash, np.diff(first)
        item_of, offset, _ = pieces(size)
        found = []
        for a in range(0, len(start), EMBEDDED):
            k = embedded(h, start[a : a + EMBEDDED], end[a : a + EMBEDDED], m)
            flat = k.ravel()
            lo = np.searchsorted(key, flat)
            hit = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == flat)
            n = np.searchsorted(key, flat[hit], "right") - lo[hit]
            piece = piece_of[np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            at = start[a : a + EMBEDDED][np.repeat(hit // k.shape[1], n)]
            # Where the item would begin; in which text the piece was found stays.
            found.append(np.stack([item_of[piece], doc_of[at], at - offset[piece]], axis=1))
        if not found or not sum(map(len, found)):
            return
        pairs = np.unique(np.concatenate(found), axis=0)
        # Windows of one item that begin near one another are one stretch.
        item, doc, at = pairs[:, 0], pairs[:, 1], pairs[:, 2]
        cut = np.concatenate([[0], np.flatnonzero((item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size[item[1:]])) + 1, [len(item)]])
        all_words = get(self.folder, f"{s}-word", "u8")
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, d = int(item[a]), int(doc[a])
            whole, most = int(size[i]), int(edits_allowed(size[i], self.similarity))
            was = out.get((d, i))
            if was is not None and was.edits == 0:
                continue
            it = np.array(all_words[first[i] : first[i + 1]])
            x, y = max(int(at[a]) - most, int(words.first[d])), min(int(at[b - 1]) + whole + most, int(words.first[d + 1]))
            # A match keeps all of the item's words but for the edits.
            if np.isin(it, h[x:y]).sum() < whole - most:
                continue
            edits, stop = edits_within(it, h[x:y])
            if edits > most:
                continue
            # The same from the end backwards gives the beginning.
            _, back = edits_within(it[::-1], h[x : x + stop][::-1])
            hit = Hit(d, i, x + stop - back - int(words.first[d]), x + stop - int(words.first[d]), edits)
            if was is None or (hit.edits, hit.start) < (was.edits, was.start):
                out[d, i] = hit


def _within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    # A table of 2^20 places answers for most.
    maybe = np.zeros(1 << 20, bool)
    maybe[(among >> np.uint64(44)).astype(np.int64)] = True
    out = maybe[(x >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = among[np.minimum(np.searchsorted(among, x[at]), len(among) - 1)] == x[at]
    return out


def index(benchmark: DataFrame, similarity: float = 0.8, item_col: str = "item_id", text_col: str = "text") -> Index:
    """The items of the benchmark as arrays in the shared folder. Items without an id, a text or a word match nothing."""
    spark = benchmark.sparkSession
    folder = new_path(spark, "benchmark")
    x = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(x.schema["id"].dataType)
    shards = max(1, -(-int(x.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["text", "id"])
        batch = pa.RecordBatch.from_arrays([pa.array(part["id"].tolist(), kind)], ["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        put(folder, f"{key[0]}-ids", np.frombuffer(sink.getvalue(), np.uint8))
        _write(folder, int(key[0]), part["text"].tolist())
        return pd.DataFrame({"n": [len(part)]})

    x = x.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))
    x.groupBy("shard").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return Index(folder, shards, similarity)


# --- the operators -----------------------------------------------------------


def find_overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, start_word, end_word, edits, similarity): the best match of each document and item that match.

    A document matches if some stretch of it is within floor(n * (1 - similarity))
    word edits of the item's n words: items of under five words match as they
    are. Nearly all matches are found (README: recall by length). Null or
    wordless texts and items match nothing; an empty table on either side gives
    an empty one; rows of equal ids are searched each, equal items match each;
    very long texts are searched whole; other columns are ignored. Ids are of any
    type. The benchmark is indexed at once, documents when the result is asked.
    """
    x = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = index(benchmark, similarity, item_col, item_text_col)
    more = T.StructType().add("start_word", T.IntegerType()).add("end_word", T.IntegerType()).add("edits", T.IntegerType()).add("similarity", T.DoubleType())
    out = T.StructType([x.schema["id"], T.StructField("item_id", benchmark.schema[item_col].dataType), *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [normal(t) for t in b.column(1).to_pylist()]
            for i, j in blocks([len(t) for t in raw]):
                for s, hits in found.hits(raw[i:j]):
                    size = np.diff(get(found.folder, f"{s}-first", "i8"))
                    at = pa.array([h.item for h in hits], pa.int64())
                    cols = [pa.array([getattr(h, f) for h in hits], pa.int32()) for f in ("start", "end", "edits")]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + h.doc for h in hits], pa.int64())), found.ids(s).take(at), *cols, pa.array([1 - h.edits / int(size[h.item]) for h in hits], pa.float64())], out.names)

    return x.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that match an item as find_overlaps says; rows with a null text, and all other columns, stay.

    Texts are searched whole, however long; of repeated rows all go or all stay; an empty table gives an empty one.
    """
    place = docs.columns.index(text_col)
    found = index(benchmark, similarity, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [normal(t) for t in b.column(place).to_pylist()]
            stays = np.ones(b.num_rows, bool)
            for i, j in blocks([len(t) for t in raw]):
                for _, hits in found.hits(raw[i:j]):
                    stays[[i + h.doc for h in hits]] = False
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
