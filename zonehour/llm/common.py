"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from zonehour.shared import delete, dropped, new_path, shared_folder, staged, tidy

__all__ = ["delete", "dropped", "new_path", "shared_folder", "staged", "tidy"]

#: Words of every contract: runs of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; longer documents are steps of their own.
BLOCK_BYTES = 2 << 20


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowered(text: Column) -> Column:
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


# --- words as hashes, a block of documents at a time -------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[_SPACE] = 0
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _powers(_BASE, 1024)


class Words:
    """The words of some documents, as 64-bit hashes in one array.

    `first[d]:first[d + 1]` are the words of document d; `start` and `end` are
    their byte places in `raw`.
    """

    def __init__(self, texts: list[bytes]):
        global _pow
        self.raw = b" ".join(texts) + b" "
        buf = np.frombuffer(self.raw, np.uint8)
        gap = np.empty(len(buf) + 1, bool)
        gap[0] = True
        np.take(_SPACE, buf, out=gap[1:])
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.end = np.flatnonzero(~gap[:-1] & gap[1:])
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)
        n = len(self.start)
        if not n:
            self.hash = np.zeros(0, np.uint64)
            return
        longest = int((np.diff(np.append(self.start, len(buf)))).max()) + int(self.start[0]) + 1
        if longest > len(_pow):
            _pow = _powers(_BASE, longest)
        place = np.arange(len(buf), dtype=np.int64)
        place[self.start[0] :] -= np.repeat(self.start, np.diff(np.append(self.start, len(buf))))
        self.hash = mix64(np.add.reduceat(_BYTE[buf] * _pow[place], self.start))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h *= _BASE
        h += words[k : len(words) - n + 1 + k]
    return mix64(h)


def blocks(sizes: list[int], most: int = BLOCK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of about `most` bytes, and `rows` rows at most; a longer row is a run of its own."""
    a = total = 0
    for i, s in enumerate(sizes):
        if i > a and (total + s > most or i - a >= rows):
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
