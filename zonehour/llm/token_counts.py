"""Token counts by byte-pair merging, without making any identifiers.

A text's symbols are a linked list; a heap holds the adjacent pairs that are in
the vocabulary. The pair of the lowest rank (leftmost on a tie) is merged until
none is left, and the count is the number of first symbols minus the merges.
Pieces never reach from a word into the next one's leading mark, so a text
falls into segments that are counted once and remembered in a bounded table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import text_bytes

MARK = "▁"
#: Segments that each of the two generations of a worker's table keeps.
REMEMBERED = 200_000
#: Characters of a segment at most that is worth remembering.
SHORT = 64
#: Texts that show whether a vocabulary treats spaces and marks as counted here.
PROBES = ("a", " a", "a ", "  a   b ", "a\n b", "Ａ ｶﾞ ﬁ ² é e\u0301", "\u3000x\u00a0y", "tab\tend")


def _pairs_of(symbols: list[str], rank: dict[str, int]) -> int:
    """Number of merges that byte-pair encoding makes of these symbols."""
    n = len(symbols)
    text, left, right = symbols[:], list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank[p], i, p) for i in range(n - 1) if (p := text[i] + text[i + 1]) in rank]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, p = heapq.heappop(heap)
        j = right[i]
        if j < 0 or not text[i] or text[i] + text[j] != p:
            continue  # one of the two has been merged meanwhile
        text[i], text[j] = p, ""
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        merges += 1
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (q := text[a] + text[b]) in rank:
                heapq.heappush(heap, (rank[q], a, q))
    return merges


class Counter(dict):
    """segment -> tokens; a miss is counted by merging. Keeps two bounded generations."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_score = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        scores = [sp.get_score(i) for i in by_score]
        ranks = []
        for k, s in enumerate(scores):
            ranks.append(ranks[-1] if k and s == scores[k - 1] else k)
        self.rank = {sp.id_to_piece(i): r for i, r in zip(by_score, ranks, strict=True)}
        self.falls_to_bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.old: dict[str, int] = {}
        alone = [c for c in "\n\r\t" if not any(c in p for p in self.rank)]
        #: Only where no piece has a mark after another character do segments stand alone.
        whole = any(MARK in p.lstrip(MARK) for p in self.rank)
        cut = re.escape("".join(alone))
        self.segments = re.compile(r"(?s).+" if whole else f"[{cut}]?{MARK}*[^{MARK}{cut}]+|[{cut}]?{MARK}+|[{cut}]")

        if wrong := [p for p in PROBES if self.count(p) != len(sp.encode(p))]:
            raise ValueError(f"this vocabulary's normaliser is not supported: {wrong[0]!r}")

    def __missing__(self, segment: str) -> int:
        if (n := self.old.get(segment)) is None:
            symbols = list(segment)
            n = len(symbols) - _pairs_of(symbols, self.rank)
            if self.falls_to_bytes:
                n += sum(len(c.encode()) - 1 for c in symbols if not c.isascii() and c not in self.rank)
        if len(segment) > SHORT:
            return n
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[segment] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segments.findall(MARK + text.replace(" ", MARK))))


@lru_cache(2)
def _counter(model_path: str) -> Counter:
    return Counter(model_path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the vocabulary's library would count.

    No begin, end or other added tokens, no truncation. A null text counts as
    empty: 0 bytes, 0 tokens. Other columns of docs are ignored, repeated rows
    give repeated results, an empty table an empty one. Very long texts are
    counted whole. A vocabulary whose library changes texts before it cuts them,
    other than by a leading mark, is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for b in batches:
            texts = text_bytes(b.column(1))
            n = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = x.schema["id"].dataType.simpleString()
    x = x.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return x.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
