"""Media columns kept as content-defined chunks.

A payload becomes a grey 8-bit image (binary PGM, `WIDTH` samples a row). The
image's bytes are cut where a rolling gear hash hits a mask, so that an
insertion moves cuts only near it. A chunk is stored once, under its digest; a
media item is the ordered list of its chunks' digests. Reading joins the lists
to the store, puts each item together, checks every digest and the whole, and
computes features of the samples read back.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.llm.common import blocks, delete, mix64, new_path, staged, text_bytes, tidy

#: Samples a row; payloads are padded with spaces to a positive multiple of this.
WIDTH = 192
#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, MEAN, MOST = 2048, 4096, 32768
#: Items that get one chunk from one task.
HOT_ROWS = 2_000
#: Digests that a task remembers, so as not to send their chunks again.
REMEMBERED = 100_000

_GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)
_MASK = np.uint32(MEAN - 1) << np.uint32(32 - (MEAN - 1).bit_length())


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def to_media(payload: bytes) -> bytes:
    """The payload as a PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a PGM image."""
    kind, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def cuts(media: list[bytes]) -> Iterator[list[int]]:
    """Ends of the chunks of each item. The gear hash of a place depends on the 32 bytes up to it only."""
    buf = np.frombuffer(b"".join(media), np.uint8)
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero((h & _MASK) == 0) + 1
    begin = 0
    for m in media:
        mine = places[np.searchsorted(places, begin) : np.searchsorted(places, begin + len(m))] - begin
        ends, at = [], 0
        while len(m) - at > LEAST:
            k = np.searchsorted(mine, at + LEAST)
            end = min(int(mine[k]) if k < len(mine) else len(m), at + MOST, len(m))
            ends.append(end)
            at = end
        if at < len(m):
            ends.append(len(m))
        yield ends
        begin += len(m)


def _chunked(column: pa.Array) -> Iterator[tuple[bytes, bytes, list[int]]]:
    """Of each text the payload's digest, the media bytes and the chunks' ends."""
    texts = text_bytes(column)
    for a, b in blocks([len(t) for t in texts]):
        payloads = [pad(t) for t in texts[a:b]]
        media = [to_media(p) for p in payloads]
        for p, m, ends in zip(payloads, media, cuts(media), strict=True):
            yield hashlib.sha256(p).digest(), m, ends


def chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, data) of the chunks of all texts, each at least once; data is compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for b in batches:
            digests, data, size = [], [], 0
            for _, m, ends in _chunked(b.column(0)):
                for at, end in zip([0, *ends], ends, strict=False):
                    d = hashlib.sha256(m[at:end]).digest()
                    if d in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    digests.append(d)
                    data.append(squeeze(m[at:end]))
                    size += len(data[-1])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])
                        digests, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest binary, data binary")


def recipes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(media_id, seq, n, digest): the ordered n chunks of each distinct text; media_id is its payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            ids, seq, count, digests = [], [], [], []
            for p, m, ends in _chunked(b.column(0)):
                if p in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(p)
                for k, (at, end) in enumerate(zip([0, *ends], ends, strict=False)):
                    ids.append(p), seq.append(k), count.append(len(ends)), digests.append(hashlib.sha256(m[at:end]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(seq, pa.int32()), pa.array(count, pa.int32()), pa.array(digests, pa.binary())], ["media_id", "seq", "n", "digest"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "media_id binary, seq int, n int, digest binary").distinct()


def write_store(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The chunk store: one row per digest, bucketed by it, so that lists join to it without moving chunks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"zonehour_chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    once = found.repartition(n, "digest").dropDuplicates(["digest"])
    with tidy(spark):
        once.write.format("parquet").bucketBy(n, "digest").option("path", path).option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    out.stored_as = name, path
    return out


def drop_store(store: DataFrame) -> None:
    """Takes a store out of the catalogue, and its files away."""
    name, path = store.stored_as
    store.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete(store.sparkSession, path)


def _with_data(lists: DataFrame, store: DataFrame) -> DataFrame:
    """lists with the data of their chunks, NULL if the store lacks one. A chunk of more than HOT_ROWS items is dealt to a task for each that many."""
    every = ["media_id", "seq", "n", "digest", "data"]
    hot = staged(lists.groupBy("digest").agg(F.count("*").alias("items")).where(F.col("items") > HOT_ROWS).select("digest", F.ceil(F.col("items") / HOT_ROWS).cast("int").alias("salts")), "media-hot")
    if hot.isEmpty():
        return lists.join(store, "digest", "left").select(*every)
    some = lists.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("media_id", "seq"), F.col("salts")).cast("int")).drop("salts")
    parts = store.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    rest = lists.join(hot, "digest", "left_anti").join(store, "digest", "left").select(*every)
    return rest.unionByName(some.join(parts, ["digest", "salt"], "left").select(*every))


def read_media(store: DataFrame, lists: DataFrame) -> DataFrame:
    """(media_id, media): every item put together from its chunks, all digests checked; a missing chunk is an error. Items of one chunk need not be moved."""
    found = [_with_data(lists.where(c), store).select("media_id", "seq", "digest", "data") for c in ("n = 1", "n > 1")]
    pieces = [found[0], found[1].repartition("media_id").sortWithinPartitions("media_id", "seq")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        now, parts = None, []

        def item() -> tuple[bytes, bytes]:
            media = b"".join(parts)
            if hashlib.sha256(from_media(media)).digest() != now:
                raise ValueError(f"media {now.hex()} doesn't match its digest")
            return now, media

        def batch(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.binary()) for k in (0, 1)], ["media_id", "media"])

        for b in batches:
            done, size = [], 0
            for media_id, digest, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if media_id != now:
                    if now is not None:
                        done.append(item())
                        size += len(done[-1][1])
                        if size > 8 << 20:
                            yield batch(done)
                            done, size = [], 0
                    now, parts = media_id, []
                if data is None:
                    raise ValueError(f"chunk {digest.hex()} is missing")
                chunk = expand(data)
                if hashlib.sha256(chunk).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                parts.append(chunk)
            yield batch(done)
        if now is not None:
            yield batch([item()])

    one, more = (p.mapInArrow(run, "media_id binary, media binary") for p in pieces)
    return one.union(more)


def _features(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    n = np.bincount(x.ravel(), minlength=256)
    p = n[n > 0] / x.size
    mean = float(n @ np.arange(256)) / x.size
    std = float(np.sqrt(max(n @ (np.arange(256.0) ** 2) / x.size - mean * mean, 0)))
    steps = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum())
    return f"rows={len(x)};mean={mean:.4f};std={std:.4f};min={x.min()};max={x.max()};entropy={-(p * np.log2(p)).sum():.4f};steps={steps}"


def media_features(media: DataFrame) -> DataFrame:
    """(media_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of what was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = from_media(m)
                rows.append((media_id, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), _features(p)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    names = ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.mapInArrow(run, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, features ...) of every row: texts stored as chunked media, read back and measured.

    A null text counts as empty: a payload of WIDTH spaces. Equal texts share
    one item and have equal values; repeated rows are rows of the result each.
    Very long texts are many chunks, and put together whole by one task. All media are stored, read back and
    measured at once; then the chunks go.
    Other columns are ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    store = write_store(spark, chunks(docs, text_col))
    measured = staged(media_features(read_media(store, staged(recipes(docs, text_col), "media-lists"))), "media-measured")
    drop_store(store)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(text)
    spaces = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    ids = docs.select(F.col(id_col).alias("id"), n.cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(text, F.repeat(F.lit(" "), spaces)).cast("binary"), 256)).alias("media_id"))
    return ids.join(measured, "media_id").drop("media_id").withColumnRenamed("id", id_col)
