"""Near duplicates by SimHash fingerprints, compared exactly tile by tile.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it. Two fingerprints link at `radius` differing bits or fewer. By the
pigeonhole principle such a pair agrees on two of radius + 2 bit fields, so the
distinct fingerprints are dealt out by (two fields, their values): of radius 3
by some 26 bits. Within such a group they
are cut into tiles by population count, since a pair within the radius cannot
differ in that by more; tile pairs beyond it are skipped, the others are
compared whole, by numpy exclusive-or and bit counts. A tile pair gives at most
a spanning forest of links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour.llm.common import Words, blocks, gram_hash, mix64, staged, text_bytes
from zonehour.llm.components import components

#: Rows of a tile at most; a group of more fingerprints becomes several tiles.
TILE = 1024
#: Rows of a group up to which its pairs are simply all compared and linked.
FEW = 16
#: Fingerprints of a group at most, beyond which its tiles are dealt out as tasks of their own.
GROUP = 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64, max(1, len(w) - words + 1))
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * votes > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number; a null text counts as empty, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in text_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which links (a, b) of n nodes join two parts that the links before them haven't."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            up[y] = x
            keep.append(k)
    return np.array(keep, np.int64)


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a spanning forest of a tile pair, by breadth-first search."""
    free_r, free_c = near.any(axis=1), np.ones(near.shape[1], bool)
    rows, cols = [], []
    for seed in np.flatnonzero(free_r).tolist():
        if not free_r[seed]:
            continue
        free_r[seed] = False
        todo_r, todo_c = [seed], []
        while todo_r or todo_c:
            if todo_r:
                r = todo_r.pop()
                new = np.flatnonzero(near[r] & free_c)
                free_c[new] = False
                todo_c += new.tolist()
                rows.append(np.full(len(new), r)), cols.append(new)
            else:
                c = todo_c.pop()
                new = np.flatnonzero(near[:, c] & free_r)
                free_r[new] = False
                todo_r += new.tolist()
                rows.append(new), cols.append(np.full(len(new), c))
    return np.concatenate(rows), np.concatenate(cols)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, of which each row has one or more 64-bit words; broadcasts over the rows."""
    total = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.uint16)
    for k in range(1, x.shape[-1]):
        total += np.bitwise_count(x[..., k] ^ y[..., k])
    return total


def _leaders(x: np.ndarray, radius: int, most: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compares all rows with a few of them: the leader that each row links to first, or -1, and those links."""
    lead = np.full(len(x), -1)
    a, b = [], []
    for _ in range(most):
        free = np.flatnonzero(lead < 0)
        if len(free) < 2:
            break
        near = free[_apart(x[free], x[free[:1]]) <= radius]
        lead[near] = free[0]
        a.append(np.full(len(near) - 1, free[0])), b.append(near[1:])
    return lead, np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _links(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints x and y, or within x.

    Tiles hold rows of like population counts, and rows known to be linked to
    the same leader; pairs of tiles that one leader holds together, or whose
    population counts are beyond the radius of one another, are skipped.
    """
    count = lambda v: np.bitwise_count(v).sum(axis=1, dtype=np.int64)
    if y is None:
        lead, a, b = _leaders(x, radius)
        order = np.lexsort((count(x), lead))
        x, lead = x[order], lead[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        found = [np.stack([back[a], back[b]])]
        z, zlead, shift = x, lead, 0
        names = order
    else:
        ox, oy = np.argsort(count(x), kind="stable"), np.argsort(count(y), kind="stable")
        names = np.concatenate([ox, len(x) + oy])
        x, z, shift = x[ox], y[oy], len(x)
        lead, zlead, found = np.full(len(x), -1), np.full(len(z), -2), []
    px, pz = count(x), count(z)
    n = shift + len(z)
    for i in range(0, len(x), TILE):
        p, held = px[i : i + TILE], lead[i : i + TILE]
        for j in range(i if y is None else 0, len(z), TILE):
            q, other = pz[j : j + TILE], zlead[j : j + TILE]
            if p.min() - q.max() > radius or q.min() - p.max() > radius:
                continue
            if held[0] >= 0 and held[0] == held[-1] == other[0] == other[-1]:
                continue
            near = _apart(x[i : i + TILE, None], z[None, j : j + TILE]) <= radius
            if y is None and i == j:
                near = np.triu(near, 1)
            if near.any():
                r, c = _spanning(near)
                found.append(np.stack([r + i, c + j + shift]))
    r, c = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    k = _forest(r, c, n)
    return names[r[k]], names[c[k]]


def _compare(radius: int):
    """Over rows (key, side, node, fp) sorted by key, the links (a, b) of each key's tiles. fp: whole 64-bit words."""

    def pieces(fp: np.ndarray, node: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not side.any():
            r, c = _links(fp, None, radius)
            return node[r], node[c]
        x, y = side == 1, side == 2
        r, c = _links(fp[x], fp[y], radius) if x.any() and y.any() else (np.zeros(0, np.int64),) * 2
        both = np.concatenate([node[x], node[y]])
        return both[r], both[c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cols.append(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            if rest is not None and len(rest[0]):
                cols = [np.concatenate([p, q]) for p, q in zip(rest, cols, strict=True)] if len(cols[0]) else rest
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            rest = [c[last:] for c in cols]
            yield from done([c[:last] for c in cols])
        if rest is not None:
            yield from done(rest)

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, side, node, fp = cols
        if not len(key):
            return
        cut = np.flatnonzero(np.diff(key)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        small = end - first <= FEW
        # Small groups together: each row against the one k places on, as long as that is of its group.
        end_of = np.repeat(np.where(small, end, first), end - first)
        at = np.arange(len(key))
        for k in range(1, FEW):
            at = at[at + k < end_of[at]]
            if not len(at):
                break
            hit = at[_apart(fp[at], fp[at + k]) <= radius]
            if len(hit):
                out.append((node[hit], node[hit + k]))
        for g in np.flatnonzero(~small):
            s = slice(first[g], end[g])
            out.append(pieces(fp[s], node[s], side[s]))
        if out:
            a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """rows(key, node, fp) -> (a, b): the links within each key's rows, as a forest or, in small groups, all.

    A key of more than GROUP rows is cut into tiles by a hash; each pair of its
    tiles is a key of its own.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    sizes = staged(sizes.select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("tiles")), "simhash-hot")
    rows = rows.join(sizes, "key", "left") if sizes.take(1) else rows.withColumn("tiles", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    with_all = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(own, t).alias("i"), F.greatest(own, t).alias("j"), F.when(t == own, 0).when(own < t, 1).otherwise(2).alias("side")))
    alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side")))
    rows = rows.withColumn("t", F.explode(F.when(F.col("tiles").isNull(), alone).otherwise(with_all)))
    key = F.xxhash64("key", "t.i", "t.j")
    dealt = rows.select(key.alias("key"), F.col("t.side").alias("side"), "node", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps(fp), distinct -> (a, b): links between fingerprints whose components are those of all pairs within the radius."""
    fields = radius + 2
    at = [64 * k // fields for k in range(fields + 1)]
    masks = [((1 << at[k + 1]) - (1 << at[k])) for k in range(fields)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = [F.xxhash64(F.lit(i * fields + j), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j])))) for i, j in combinations(range(fields), 2)]
    # The bytes of a signed number, smallest first, as the comparison reads them.
    raw = F.reverse(F.array(*[F.substring(F.unhex(F.lpad(F.hex("fp"), 16, "0")), k, 1) for k in range(1, 9)]))
    return _dealt(fps.select(F.col("fp").alias("node"), F.concat(*[raw[k] for k in range(8)]).alias("fp"), F.explode(F.array(*parts)).alias("key")), radius)


# --- documents of at least some similarity -----------------------------------

#: 64-bit words of a wide fingerprint, and the radius in it within which pairs are candidates: nearly all of a Jaccard similarity of 0.8 of the shingles.
WIDE, WIDE_RADIUS = 4, 72
#: Pieces of a document that are compared, and shingles of a piece at least, on average.
PIECES, PIECE = 16, 3
#: Shingles of a text up to which not pieces but single shingles are keys.
SMALL = 64
#: Texts that hold a shingle from which on it is frequent: the others of a text are its keys before it.
FREQUENT = 64
#: Texts whose shingle sets a task compares at once are up to two tiles of so many.
SETS = 256


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    return mix64(h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))


def shingles(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its word shingles, sorted; none without words. A-Z count as lower case."""
    for a, b in blocks([len(t) for t in texts]):
        w = Words([t.lower() for t in texts[a:b]])
        h = gram_hash(w.hash, words)
        for first, end in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            n = end - first
            yield np.unique(h[first : end - words + 1] if n >= words else gram_hash(w.hash[first:end], max(1, n)))


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A text's SimHash of WIDE words over its distinct shingles, and its keys where no shingle is frequent."""
    h = next(shingles([text], words))
    fp, pieces = _wide(h)
    return fp, np.concatenate([mix64(h[: len(h) // 5 + 1])] * _is_small(h) + [pieces])


def _is_small(h: np.ndarray) -> bool:
    """Whether single shingles are keys of the set, for it may be like one of up to SMALL."""
    return 0 < 4 * len(h) <= 5 * SMALL


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits, of WIDE words, that more than half of the hashes have; each word's bits come from a hash of its own."""
    votes = np.zeros(64 * WIDE, np.int64)
    # Up to 255 rows add up in bytes.
    for a in range(0, len(h), 255):
        part = h[a : a + 255]
        bits = np.unpackbits(np.stack([_mixed(part, k) for k in range(WIDE)], axis=1).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)


def _wide(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of a set of shingles, and the keys of its pieces.

    Sets of more than SMALL shingles are dealt to pieces by the shingles' hashes; a piece's key stands for all shingles in
    it. Of two such sets of 0.8 similarity, some 0.2 % share none. The number of
    pieces goes by a size class; sets near the next class have keys of both.
    """
    if not len(h):
        return np.zeros(WIDE, np.uint64), np.zeros(1, np.uint64)
    fp = _majority(h)
    n, level = len(h), int(len(h)).bit_length() - 1
    keys = [np.zeros(0, np.uint64)]
    for v in (level - 1, level, level + 1) if n > SMALL else ():
        if v == level - 1 and n > 1.25 * 2**level or v == level + 1 and n < 0.8 * 2**v:
            continue
        of = _mixed(h, 99) % np.uint64(2**v // PIECE)
        used = of < PIECES
        sums = np.zeros(PIECES, np.uint64)
        np.add.at(sums, of[used].astype(np.int64), mix64(h[used]))
        at = np.flatnonzero(np.bincount(of[used].astype(np.int64), minlength=PIECES))
        keys.append(mix64(sums[at] + np.uint64(v * PIECES + 1) + at.astype(np.uint64)))
    return fp, np.concatenate(keys)


def _with_wide(texts: DataFrame, words: int) -> DataFrame:
    """texts(id, t, text) -> (id, t, fp, wide, pieces, small): fp is the name of the text's set of shingles, small the set if it is small, else NULL."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*texts.schema.fields[:2], T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("pieces", longs), T.StructField("small", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, wide, pieces, small = [], [], [], []
            for h in shingles(text_bytes(b.column(2)), words):
                fp, keys = _wide(h)
                names.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)), wide.append(fp.tobytes()), pieces.append(keys.view(np.int64)), small.append(h.view(np.int64) if _is_small(h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(names, pa.int64()), pa.array(wide, pa.binary()), pa.array(pieces, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64()))], schema.names)

    return texts.mapInArrow(run, schema)


def candidate_keys(fps: DataFrame) -> DataFrame:
    """fps(fp, wide, pieces, small) -> (node, fp, key): the keys by which distinct sets meet.

    Of sets with a similarity of 0.8, each holds at least 0.8 of the other's
    size in common with it, so that the first fifth of the two in one order, and
    one more, have a shingle in common. These are the keys of a small set, in the order of how many small sets have
    them: a line that very many texts share comes last, and is a key only of texts that are
    little else. Shingles that fewer than FREQUENT sets have count alike.
    """
    large = fps.where(F.size("pieces") > 0).select("fp", "wide", "pieces").dropDuplicates(["fp"])
    large = large.select(F.col("fp").alias("node"), F.col("wide").alias("fp"), F.explode("pieces").alias("key"))
    sets = fps.where(F.col("small").isNotNull()).select(F.col("fp").alias("node"), F.col("wide").alias("fp"), "small").dropDuplicates(["node"])
    sets = staged(sets, "simhash-small")
    often = sets.select(F.explode("small").alias("h")).groupBy("h").agg(F.count("*").alias("often")).where(F.col("often") >= FREQUENT)
    often = staged(often, "simhash-frequent")
    each = sets.select("node", F.explode("small").alias("h")).join(often, "h", "left").select("node", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h").alias("s"))
    # Of a set of a few dozen shingles.
    first = each.groupBy("node").agg(F.array_sort(F.collect_list("s")).alias("s")).select("node", F.explode(F.slice("s", F.lit(1), F.floor(F.size("s") / 5).cast("int") + 1)).alias("s"))
    small = sets.select("node", "fp").join(first, "node").select("node", "fp", F.xxhash64(F.lit("shingle"), "s.h").alias("key"))
    return large.unionByName(small)


def _alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of 0.8 or more, by breadth-first search."""
    size = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark, free, found = np.zeros(int(size.sum()), bool), np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        todo = [seed] if free[seed] else []
        free[seed] = False
        while todo:
            k = todo.pop()
            c = np.flatnonzero(free & (5 * size >= 4 * size[k]) & (4 * size <= 5 * size[k]))
            mark[ids[k]] = True
            both = np.array([np.count_nonzero(mark[ids[j]]) for j in c.tolist()], np.int64)
            mark[ids[k]] = False
            near = c[9 * both >= 4 * (size[k] + size[c])].tolist()
            free[near] = False
            todo += near
            found += [(k, j) for j in near]
    return found


def _sets(words: int):
    """(component, node, text) -> (component, node, set): the text's distinct shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([h.tobytes() for h in shingles(text_bytes(b.column(2)), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], sets], ["component", "node", "set"])

    return run


def _compared(rows: DataFrame) -> DataFrame:
    """rows(key, rank, node, set) -> (a, b): links within each key's rows.

    A row of rank 0 leads its key: rows that no links join to it are (node, null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, led, nodes, sets = None, False, [], []
        for b in batches:
            out = []
            for key, rank, node, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key != last:
                    out += done(led, nodes, sets)
                    last, led, nodes, sets = key, rank == 0, [], []
                nodes.append(node), sets.append(np.frombuffer(raw, np.uint64))
            yield batch(out)
        yield batch(done(led, nodes, sets))

    def done(led: bool, nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int | None]]:
        found = _alike(sets) if sets else []
        out: list[tuple[int, int | None]] = [(nodes[i], nodes[j]) for i, j in found]
        if led:
            reached = {0}
            for i, j in found:
                if i in reached:
                    reached.add(j)
            out += [(nodes[k], None) for k in range(len(nodes)) if k not in reached]
        return out

    def batch(found: list[tuple[int, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select("key", "rank", "node", "set").repartition("key").sortWithinPartitions("key", "rank").mapInArrow(run, "a long, b long")


def similar_links(candidates: DataFrame, texts: DataFrame, words: int = 5) -> DataFrame:
    """(a, b): links whose components are those of all pairs of 0.8 similarity and more within each component of candidates.

    candidates(node, t, component), of one row per node; texts(t, text). A
    component of more than SETS texts is cut into tiles by a hash, each compared
    together with one text of the component, its leader. What is linked to the
    leader needs no comparison with its like; only what isn't meets the tiles of
    all others, so that the copies of one text, however many, are sent twice at most.
    """
    rows = texts.join(candidates, "t").select("component", "node", "text").dropDuplicates(["node"])
    sets = staged(rows.mapInArrow(_sets(words), "component long, node long, set binary"), "simhash-sets")
    n_tiles = F.ceil(F.count("*") / SETS).cast("int")
    sizes = sets.groupBy("component").agg(n_tiles.alias("tiles"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("leader"))
    sets = sets.join(staged(sizes, "simhash-sizes"), "component")
    leads = (F.col("tiles") > 1) & (F.col("node") == F.col("leader"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = sets.withColumn("tile", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own))))
    found = staged(_compared(dealt.select(F.xxhash64("component", "tile").alias("key"), F.when(leads, 0).otherwise(1).alias("rank"), "node", "set")), "simhash-led")
    links = found.where("b is not null")
    rest = found.where("b is null").select(F.col("a").alias("node"), F.lit(True).alias("free"))
    if not rest.take(1):
        return links
    # Tiles of the rest come first; each of its rows meets every tile, a row linked to the leader those of the rest.
    split = staged(sets.select("component", "node").join(rest, "node", "left").withColumn("free", F.coalesce("free", F.lit(False))), "simhash-rest")
    tiles = split.groupBy("component").agg(*[F.ceil(F.count_if(F.col("free") == F.lit(x)) / SETS).cast("int").alias(k) for k, x in (("first", True), ("others", False))]).where("first > 0")
    rows = sets.select("node", "set").join(split.join(tiles, "component"), "node")
    own = F.when(F.col("free"), F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    upto = F.col("first") + F.when(F.col("free"), F.col("others")).otherwise(0)
    pairs = F.transform(F.sequence(F.lit(0), upto - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    dealt = rows.withColumn("p", F.explode(pairs)).select(F.xxhash64("component", "p.i", "p.j").alias("key"), F.lit(1).alias("rank"), "node", "set")
    return links.union(_compared(dealt))


def groups(fps: DataFrame, links: DataFrame) -> DataFrame:
    """fps(id, fp), links between fps -> (fp, component_id, first): the smallest id of each component, and whether this fp has it.

    A component without any id has a null component_id; its smallest fp is first.
    """
    reps = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    labels = components(links).withColumnRenamed("node", "fp")
    linked = reps.join(labels, "fp")
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("best"))
    linked = linked.join(best, "component").select("fp", F.col("best.rep").alias("component_id"), (F.col("best.fp") == F.col("fp")).alias("first"))
    linked = linked.withColumn("linked", F.lit(True))
    alone = F.col("linked").isNull()
    return reps.join(linked, "fp", "left").select("fp", F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    component_id: the smallest id that links reach, itself included. Texts
    without words (null, empty, blank) have fingerprint 0 and link like any
    other. Rows of equal ids have a result each; a row without an id belongs to
    its component like any other, whose smallest id is null only if none there
    has one. Very long texts are hashed whole, a block at a time; an empty table
    gives an empty one. Other columns are ignored, whatever their names.
    """
    fps = staged(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    # A table, so that the join's exchanges are plain and a hot fingerprint's rows can be split.
    of = staged(groups(fps, near_links(fps.select("fp").distinct(), radius)), "simhash-groups")
    out = fps.join(of, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one row of each group of texts that pairs of a similarity of 0.8 or more link.

    Wide fingerprints find candidates; the similarity that counts is that of the
    whole sets of shingles. The row of the smallest id stays, once if it is
    repeated; a group without any id keeps one of its rows. Texts without words
    are a group. Very long texts are compared whole; an empty table gives an empty
    one; all columns are passed on as they are, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    fps = staged(_with_wide(texts, words), "simhash-wide")
    near = components(_dealt(candidate_keys(fps), WIDE_RADIUS))
    near = staged(fps.groupBy(F.col("fp").alias("node")).agg(F.min("t").alias("t")).join(near, "node"), "simhash-near")
    links = similar_links(near, texts.select("t", "text"), words)
    first = groups(fps.select("id", "fp"), links).where("first").select(F.col("fp").alias("__first"), F.col("component_id").alias("__component"))
    # The group's row is known by its text and id, as one key, by which copies of either are one row without another exchange.
    key = lambda t, i: F.concat(t.cast("string"), F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))
    kept = fps.groupBy(F.col("id").alias("__id"), F.col("fp").alias("__fp")).agg(F.min("t").alias("__kept")).join(first, (F.col("__fp") == F.col("__first")) & F.col("__id").eqNullSafe(F.col("__component")))
    kept = staged(kept.select(key(F.col("__kept"), F.col("__id")).alias("__key")), "simhash-kept")
    out = docs.select(*docs.columns, key(F.xxhash64(text_col), F.col(id_col)).alias("__key")).join(kept, "__key", "left_semi")
    return out.dropDuplicates(["__key"]).select(*docs.columns)
