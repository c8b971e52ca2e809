"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words. Its name is the rank of the pair of
names of its halves, so that equal names mean equal words. Where a factor's next
occurrence starts d words later, d no longer than the factor, both fit into twice
its length and overlap or touch: the text has period d there. Neighbouring places
with the same d are one stretch, an arithmetic progression of occurrences with
difference d. Within a run of smallest period q, factors of q words or more occur
every q words and no sooner (a sooner one would be a smaller period), so the
factors of the least 2^k >= q find the run whole, once, with its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import blocks, text_bytes

#: Least words of a run, and least repetitions of its period.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(names: np.ndarray, doc: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, period) of the runs in the words of some documents, by place, then period.

    `names` are words as numbers, `doc` the document of each word, ascending;
    `longest` is the words of the longest document. `times` is 3 at least: with
    fewer, a run may be too short to hold a factor twice.
    """
    if times < 3:
        raise ValueError("runs repeat their period three times at least")
    found = []
    at, size = np.arange(len(names), dtype=np.int64), 1
    key = doc.astype(np.int64) * (int(names.max(initial=0)) + 1) + names
    while len(at) and size // 2 < longest // times:
        _, rank, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[rank] > 1
        at, rank = at[again], rank[again]
        order = np.argsort(rank, kind="stable")
        gap = np.zeros(len(at), np.int64)
        gap[order[:-1]] = np.where(rank[order[1:]] == rank[order[:-1]], at[order[1:]] - at[order[:-1]], 0)
        near = (gap <= size) & (gap > size // 2)
        place, period = at[near], gap[near]
        if len(place):
            head = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(period) != 0)))
            last = np.append(head[1:], len(place)) - 1
            found.append((place[head], place[last] - place[head] + period[head] + size, period[head]))
        # A factor of twice the size that occurs again has halves that do.
        right = np.searchsorted(at, at + size)
        has = np.append(at, -1)[np.minimum(right, len(at))] == at + size
        has[has] &= doc[at[has]] == doc[at[has] + size]
        key = rank[has].astype(np.int64) * (len(n) + 1) + rank[right[has]]
        at, size = at[has], 2 * size
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    good = length >= np.maximum(least, times * period)
    place, length, period = place[good], length[good], period[good]
    order = np.lexsort((period, place))
    return place[order], length[order], period[order]


def repeated(n: int, place: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words is in a run after the first period of that."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place + period, 1)
    np.add.at(edge, place + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _block(texts: list[bytes], least: int, times: int) -> tuple[list[int], list[int], pa.StructArray, list[bytes]]:
    """Words and runs of each document, all runs, and the kept words of each."""
    split = [t.split() for t in texts]  # bytes split at exactly \x20 and \x09-\x0D
    size = np.array([len(w) for w in split], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(texts)), size)
    words = [x for w in split for x in w]
    names = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False) if words else np.zeros(0, np.int64)
    place, length, period = find_runs(names, doc, int(size.max(initial=0)), least, times)
    keep = ~repeated(len(words), place, length, period)
    owner = doc[place] if len(place) else place
    kept = [b" ".join(w if keep[a:b].all() else compress(w, keep[a:b])) for w, a, b in zip(split, first[:-1], first[1:], strict=True)]
    runs = pa.StructArray.from_arrays([pa.array(place - first[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return size.tolist(), np.bincount(owner, minlength=len(texts)).tolist(), runs, kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """(id, n_words, runs, kept) of every row: its runs by start, then period, and its text without their repetitions.

    A run is a stretch of consecutive words, at least `least` and `times` its smallest period long,
    that no neighbouring word extends; starts count words from 0. `kept` has the words, joined by
    one space, that no run has after its first period. Words are bytes other than
    \\x20 and \\x09-\\x0D and compared exactly. A null, empty or blank text has no words, no runs and keeps
    the empty text; very long texts are searched whole; repeated rows have a
    result each; null ids stay; an empty table gives an empty one; other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in blocks([len(t) for t in texts]):
                n, per_doc, runs, kept = _block(texts[i:j], least, times)
                offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "kept"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    x = x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, kept string")
    return x.withColumnRenamed("id", id_col)
