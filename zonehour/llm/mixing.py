"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue with a rate, its target. The documents of a source are
shuffled by a keyed hash and pass up to `max_passes` times; a passage's virtual
finish time is the tokens of its source up to and with it, divided by the
target. All passages in the order of that time, cut where the budget is used
up, are the mix: each source advances at its own rate, and at the cut each has
given what its target asks for.

No source is ever one task: the order within a source is kept in hash-prefix
buckets, whose sums give the tokens before each bucket. The cut is found on
histograms of the finish time that are refined until one cell is small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.llm.common import staged, word_count

#: Rows that a hash-prefix bucket has on average at most, over all sources.
BUCKET_ROWS = 1_000
#: Cells of one histogram, and rows of the cell that is looked at row by row.
CELLS, CELL_ROWS = 1024, 4_096


def targets(sizes: DataFrame, weights: Sequence[float], max_passes: int) -> DataFrame:
    """(source, source_size) -> with target.

    Sources by code point, null last, weigh `weights` in turn and share the total.
    A target stops at max_passes times its source's size; the excess goes to the
    others by weight. In the order of cap / weight a source is capped exactly if
    its cap is at most its share of what the sources before it leave.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    x = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_passes).alias("cap"))
    by_fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everything = by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    x = x.withColumn("level", left.cast("double") / w_left)
    x = x.withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(W.partitionBy()).getField("level")
    return x.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def _cut(passes: DataFrame, budget: int) -> tuple[float, str | None] | None:
    """The first passage (finish, source) beyond the budget, or None if all fit. passes: finish, source, size."""
    inside, below = passes, 0
    while True:
        ends = inside.agg(F.min("finish").alias("a"), F.max("finish").alias("b")).first()
        if ends.a is None:
            return None
        cell = F.floor((F.col("finish") - F.lit(ends.a)) / F.lit((ends.b - ends.a) or 1.0) * CELLS)
        cells = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b")).collect()
        for c in sorted(cells, key=lambda c: c.cell):
            if below + c.s > budget:
                break
            below += c.s
        else:
            return None
        inside = passes.where(F.col("finish").between(c.a, c.b))
        if c.n <= CELL_ROWS or c.a == c.b:
            for r in sorted(inside.select("finish", "source", "size").collect(), key=lambda r: (r.finish, r.source is None, (r.source or "").encode())):
                below += r.size
                if below > budget:
                    return r.finish, r.source
            return None


def mix_sources(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_passes: int = 3, key: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken (tokens the mix takes of this row, repeats counted).

    size: a token count; by default the words of the text. A null text or size
    counts 0 and is never taken; a null source is a source, the last. Repeated
    rows are rows of their own; ties in the shuffle go by id, then size. Columns
    of docs named like an output column give way to it. An empty table gives an
    empty one.
    """
    out = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in out]
    depth = max(1, math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS + 1, 16)))
    h = F.md5(F.concat_ws(":", F.lit(key), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        F.struct(*kept).alias("doc"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("skey"), F.col(id_col).alias("id"),
        F.coalesce(size if size is not None else word_count(F.col(text_col)), F.lit(0)).cast("long").alias("size"), h.alias("h"), h.substr(1, depth).alias("bucket"),
    )
    sums = staged(base.groupBy("source", "skey", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    rates = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_passes)
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "skey", "bucket", before.alias("before")).alias("o").join(rates.alias("r"), F.col("o.source").eqNullSafe(F.col("r.source"))).select("skey", "bucket", "before", "source_size", "target")
    # As many rows as buckets: merged on the partitioning that the running sums need anyway, not broadcast.
    offsets = staged(offsets, "mix-offsets").hint("merge")
    run = W.partitionBy("skey", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("cum", F.sum("size").over(run)).join(offsets, ["skey", "bucket"])

    def finish(k: int) -> Column:
        return (F.col("source_size") * k + F.col("before") + F.col("cum")).cast("double") / F.col("target")

    budget = sums.agg(F.sum("bucket_size")).first()[0] or 0
    passes = staged(placed.where("size > 0").select("source", "size", *[finish(k).alias(f"f{k}") for k in range(max_passes)]), "mix-passes")
    passes = passes.select("source", "size", F.explode(F.array(*[f"f{k}" for k in range(max_passes)])).alias("finish"))
    cut = _cut(passes, int(budget))

    def within(k: int) -> Column:
        if cut is None:
            return F.lit(1)
        at, source = cut
        src = F.col("source")
        earlier = src.isNotNull() if source is None else src < F.lit(source)
        return F.when((finish(k) < F.lit(at)) | ((finish(k) == F.lit(at)) & F.coalesce(earlier, F.lit(False))), 1).otherwise(0)

    times = sum((within(k) for k in range(1, max_passes)), within(0))
    taken = F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long")
    return placed.select("doc.*", "size", "source_size", "target", taken.alias("taken"))
