"""Exact removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix begins at each word of a document that a window of `window` words
follows. Its partition is known by a prefix of variable length: that up to the
end of the smallest `gram`-word hash within its first `window` words, of which
the gram at the end is the key. Equal windows have equal such prefixes, and so
meet in one partition. Suffixes next to one another mostly end their prefixes in
the same gram, so that they travel as a run, whose words are sent once.

Partitions are counted before any words move. One whose suffixes are all of one
document can't hold a repeat and is dropped. One of more than PARTITION suffixes
gets the longest prefix, the whole window, as a 128-bit fingerprint: below that
prefix the tree is one deep node, and tasks send only the smallest document that
they know of it. In every other partition the subtree is built from the words:
ranks of prefixes of 1, 2, 4, ... words, by doubling, down to the depth of the
window. The leaves of equal rank there lie below one internal node of that
depth; all but those of its smallest document go. Leaves that follow one another
in their document are joined to the maximal repeat.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour.llm.common import Words, blocks, gram_hash, mix64, staged, text_bytes

#: Suffixes of a partition at most; larger ones get the whole window as their prefix.
PARTITION = 4096
#: Windows whose smallest document a task remembers, and rows and bytes of partitions that are looked at together at least.
REMEMBERED, ROWS, BYTES = 200_000, 50_000, 8 << 20
#: Rows of a partition's key are dealt out by so many salts while it is only counted.
SALTS = 16

_SECOND = np.uint64(0x2545F4914F6CDD1D)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def _runs_of(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first word, suffixes, key) of the runs of suffixes that end their prefixes in the same gram."""
    words = Words(texts)
    none = np.zeros(0, np.int64)
    if len(words.hash) < window:
        return none, none, none, none.astype(np.uint64)
    n = np.maximum(np.diff(words.first) - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    if not len(doc):
        return none, none, none, none.astype(np.uint64)
    word = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    key = _smallest(gram_hash(words.hash, gram), window - gram + 1)[words.first[doc] + word]
    a = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1])
    return doc[a], word[a], np.diff(np.append(a, len(doc))), key[a]


def _order(ids: pa.Array) -> np.ndarray:
    """Whole numbers in the ids' order; the ids themselves if they are such."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1].astype(np.int64)


def deep_nodes(words: np.ndarray, suffix: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix (a place in `words`, which are whole numbers) its node of that depth in the suffix tree.

    A rank stands for a prefix: that of 2k words is the rank of two of k words.
    Suffixes have `depth` words at least, so that no prefix reaches beyond.
    """
    rank, k = words.astype(np.int64), 1
    while 2 * k <= depth:
        rank = np.unique((rank[:-k] << 32) | rank[k:], return_inverse=True)[1]
        k *= 2
    if k == depth:
        return rank[suffix]
    return np.unique((rank[suffix] << 32) | rank[suffix + depth - k], return_inverse=True)[1]


def _not_least(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which leaves are not of their node's smallest document."""
    order = np.lexsort((doc, node))
    top = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    goes = np.zeros(len(node), bool)
    goes[order] = doc[order] > np.repeat(doc[order][top], np.diff(np.append(top, len(order))))
    return goes


def repeats(docs: DataFrame, window: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, start, n): the suffixes start, ..., start + n - 1 of text t of this id begin windows that a smaller id has too.

    t is the text's hash, so that rows of equal ids and unlike texts stay apart.
    Of equal texts only that of the smallest id is looked at. Rows without an id
    or a text take no part. Ids are of any type that has an order.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type = texts.schema["id"].dataType

    def schema(*more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("id", id_type), T.StructField("t", T.LongType()), *[T.StructField(n, k) for n, k in more]])

    where = (("start", T.IntegerType()), ("n", T.IntegerType()))
    run_schema, sent_schema = schema(*where, ("key", T.LongType())), schema(*where, ("key", T.LongType()), ("path", T.BinaryType()), ("words", T.BinaryType()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = text_bytes(b.column(2))
            for i, j in blocks([len(x) for x in raw]):
                doc, start, n, key = _runs_of(raw[i:j], window, gram)
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64))], run_schema.names)

    own = staged(texts.mapInArrow(runs, run_schema).groupBy("t", "start", "n", "key").agg(F.min("id").alias("id")), "substring-runs")
    sizes = own.groupBy("key").agg(F.sum("n").alias("suffixes"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    sizes = sizes.select("key", (F.col("suffixes") > PARTITION).alias("large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = own.withColumn("salt", F.pmod(F.xxhash64("t", "start"), F.lit(SALTS)).cast("int")).join(sizes, ["key", "salt"])
    asked = asked.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "n", "key", "large"))).alias("asked")).withColumnsRenamed({"id": "a_id", "t": "a_t"})
    asked = staged(asked, "substring-asked")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], object] = {}
        for b in batches:
            raw, runs_of = text_bytes(b.column(2)), b.column(3).to_pylist()
            for i, j in blocks([len(x) for x in raw]):
                src, start, n, key, words, large = [], [], [], [], [], []
                for k in range(i, j):
                    split = None
                    for r in runs_of[k]:
                        if r["large"]:
                            large.append((k, r["start"], r["n"]))
                            continue
                        split = raw[k].split() if split is None else split
                        src.append(k), start.append(r["start"]), n.append(r["n"]), key.append(r["key"])
                        words.append(b" ".join(split[r["start"] : r["start"] + r["n"] + window - 1]))
                yield rows(b, src, start, n, key, [None] * len(src), words)
                if large:
                    yield from windows(b, i, raw[i:j], large, seen)
            if len(seen) > REMEMBERED:
                seen.clear()

    def rows(b: pa.RecordBatch, src, start, n, key, path, words) -> pa.RecordBatch:
        at = pa.array(src, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(path, pa.binary()), pa.array(words, pa.binary())], sent_schema.names)

    def windows(b: pa.RecordBatch, i: int, texts: list[bytes], large: list[tuple[int, int, int]], seen: dict) -> Iterator[pa.RecordBatch]:
        """Suffixes that have the whole window as their prefix. What this task knows of a smaller document goes, and is not asked."""
        h = Words(texts)
        row, first, n = (np.array(x) for x in zip(*large, strict=True))
        src = np.repeat(row, n)
        start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = h.first[src - i] + start
        one, two = gram_hash(h.hash, window)[at], gram_hash(mix64(h.hash ^ _SECOND), window)[at]
        # A window that a document has many times is asked for once; its places travel with the fingerprint.
        order = np.lexsort((start, two, one, src))
        src, start, one, two = src[order], start[order], one[order], two[order]
        first = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        times = np.diff(np.append(first, len(src)))
        goes = np.zeros(len(first), bool)
        place = b.column(0).to_pylist()
        for k, (p, q, r) in enumerate(zip(one[first].tolist(), two[first].tolist(), src[first].tolist(), strict=True)):
            least = seen.get((p, q))
            goes[k] = least is not None and least < place[r]
            if not goes[k]:
                seen[p, q] = place[r]
        ask = np.flatnonzero(~goes)
        path = [one[f : f + 1].tobytes() + two[f : f + 1].tobytes() + start[f : f + m].astype(np.int32).tobytes() for f, m in zip(first[ask].tolist(), times[ask].tolist(), strict=True)]
        yield rows(b, src[first[ask]], start[first[ask]], times[ask], mix64(one[first[ask]]).view(np.int64), path, [None] * len(path))
        known = np.repeat(goes, times)
        back = np.lexsort((start, src))
        src, start, one, known = src[back], start[back], one[back], known[back]
        # Neighbours that are known to go are one row, with neither words nor path.
        s, w = src[known], start[known]
        a = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)])) if len(s) else np.zeros(0, np.int64)
        yield rows(b, s[a], w[a], np.diff(np.append(a, len(s))), mix64(one[known][a] + s[a].astype(np.uint64)).view(np.int64), [None] * len(a), [None] * len(a))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = size = 0
        for b in batches:
            rest.append(b)
            held, size = held + b.num_rows, size + b.nbytes
            if held < ROWS and size < BYTES:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            key = whole.column(4).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield below(whole.slice(0, cut))
                whole = whole.slice(cut)
            rest, held, size = whole.to_batches(), 0, 0
        if rest:
            yield below(pa.Table.from_batches(rest))

    def below(part: pa.Table) -> pa.RecordBatch:
        """The leaves, of each deep node with several documents, that are not in its smallest one."""
        part = part.combine_chunks()
        ids, t = (part.column(k).combine_chunks() if part.num_rows else pa.array([], part.schema.field(k).type) for k in (0, 1))
        doc = _order(ids)
        start, n = (part.column(k).to_numpy() for k in (2, 3))
        paths, words = (part.column(k).to_pylist() for k in (5, 6))
        known = np.array([p is None and w is None for p, w in zip(paths, words, strict=True)], bool)
        # Suffixes by words: runs end to end; a node's leaves are told apart within their runs.
        by_words = np.flatnonzero([w is not None for w in words])
        number = defaultdict(count().__next__)
        line = b" ".join([words[k] for k in by_words]).split()
        line = np.fromiter(map(number.__getitem__, line), np.int64, len(line))
        m = n[by_words].astype(np.int64)
        end = np.cumsum(m + window - 1)
        leaf = np.repeat(by_words, m)
        place = np.arange(len(leaf)) - np.repeat(np.cumsum(m) - m, m)
        node = deep_nodes(line, np.repeat(end - m - window + 1, m) + place, window) if len(leaf) else leaf
        by_path = np.flatnonzero([p is not None for p in paths])
        deep = np.unique(np.array([paths[k][:16] for k in by_path], "V16"), return_inverse=True)[1] if len(by_path) else by_path
        goes, gone = _not_least(node, doc[leaf]), by_path[_not_least(deep, doc[by_path])]
        places = [np.frombuffer(paths[k], np.int32, offset=16) for k in gone]
        r = np.concatenate([leaf[goes], np.repeat(gone, [len(p) for p in places]).astype(np.int64)])
        w = np.concatenate([start[leaf][goes] + place[goes], *places])
        a = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
        src = np.concatenate([np.flatnonzero(known), r[a]])
        at = pa.array(src.astype(np.int64))
        return pa.RecordBatch.from_arrays([ids.take(at), t.take(at), pa.array(np.concatenate([start[known], w[a]]).astype(np.int32)), pa.array(np.concatenate([n[known], np.diff(np.append(a, len(r)))]).astype(np.int32))], ["id", "t", "start", "n"])

    sent = texts.join(asked, (F.col("id") == F.col("a_id")) & (F.col("t") == F.col("a_t"))).select("id", "t", "text", "asked").mapInArrow(send, sent_schema)
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(trees, schema(*where))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: kept has the words left, joined by one space.

    A word goes if a window over it also starts in a document of a smaller id.
    A null or empty text has no words; rows without an id keep all theirs and
    take none from others; rows of equal ids take nothing from one another, and
    repeated rows have a result each. Very long texts are cut nowhere. Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    found = staged(repeats(docs, window, id_col=id_col, text_col=text_col), "repeats")
    spans = found.groupBy("id", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"), F.lit(False).alias("copy"))
    # Equal texts of larger ids go as a whole, if they have a window.
    names = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")).where(F.col("id").isNotNull() & F.col(text_col).isNotNull()).distinct()
    least = names.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("t", "lo", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = names.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(least, ["t", "salt"]).where("id > lo")
    copies = copies.select("id", "t", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy"))
    marks = spans.union(copies).withColumnsRenamed({"id": "s_id", "t": "s_t"})
    x = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    x = x.join(marks, (F.col("id") == F.col("s_id")) & (F.col("t") == F.col("s_t")), "left").select("id", "text", F.col("spans.start").alias("a"), F.col("spans.n").alias("n"), F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, a, n, copy in zip(text_bytes(b.column(1)), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                words = text.split()
                total.append(len(words))
                if copy and len(words) >= window:
                    words = []
                elif a:
                    turn = np.zeros(len(words) + 1, np.int64)
                    np.add.at(turn, np.array(a), 1)
                    np.add.at(turn, np.array(a) + np.array(n) + window - 1, -1)
                    stays = np.cumsum(turn[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return x.mapInArrow(run, T.StructType([x.schema["id"], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])).withColumnRenamed("id", id_col)
