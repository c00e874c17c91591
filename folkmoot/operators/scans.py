"""Running values over ordered keys of any size: a segmented scan (inventory D1 to D5, C10, C11).

Keys with at most ``segment_rows`` rows are plain windows. A larger key, say one very long meeting, would be one task;
its rows are dealt by sampled splitters into segments of neighbouring positions instead. Each segment is scanned alone and
folded to one row (its last value that is not null, its sum); these few rows are scanned per key, and each segment takes
what came before it. The segments are written to the shared folder, as both steps have to see the same splitters.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot._store import kept

SEGMENT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[f"at_{c}"]) for c in columns])


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def running(df: DataFrame, keys: list[str], order: list[str], carried: dict[str, Column] | None = None, summed: dict[str, Column] | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``df`` with, for every name of ``carried``, the latest value so far that is not null, and for every name of
    ``summed`` the sum so far; a row's own value is included, null where there was none.

    Rows go by ``order``, ascending columns that tell the rows of a key apart (null first); rows that are equal in all of
    them stay in one segment, in no set order. Null keys are a key.
    """
    carried, summed = carried or {}, summed or {}
    values = {f"own_{name}": value for name, value in (carried | summed).items()}
    rows = df.withColumns(values)
    large = df.groupBy(*[F.col(k).alias(f"at_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("at_rows")).filter(F.col("at_rows") > segment_rows)
    found = large.agg(F.count(F.lit(1)).alias("keys"), F.sum("at_rows").alias("rows")).first()

    def scanned(part: DataFrame, by: list[str]) -> DataFrame:
        so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = {name: F.last(f"own_{name}", ignorenulls=True).over(so_far) for name in carried}
        return part.withColumns(last | {name: F.sum(f"own_{name}").over(so_far) for name in summed})

    if not found["keys"]:
        return scanned(rows, keys).drop(*values)
    hot = kept(large, "large-keys")
    cold = scanned(rows.join(_sent(hot, found["keys"]), _same(rows, hot, keys), "left_anti"), keys).drop(*values)
    dealt = segments(rows.join(_sent(hot, found["keys"]), _same(rows, hot, keys), "left_semi"), keys, order, -(-found["rows"] // segment_rows))
    # Of every segment its last values and sums; then what all segments before it leave behind.
    own = [F.max_by(f"own_{name}", F.when(F.col(f"own_{name}").isNotNull(), F.struct(*order))).alias(f"of_{name}") for name in carried]
    folded = dealt.groupBy(*[F.col(k).alias(f"at_{k}") for k in keys], F.col("segment").alias("at_segment")).agg(*own, *[F.sum(f"own_{name}").alias(f"of_{name}") for name in summed])
    before = Window.partitionBy(*[f"at_{k}" for k in keys]).orderBy("at_segment").rowsBetween(Window.unboundedPreceding, -1)
    left = {f"before_{name}": F.last(f"of_{name}", ignorenulls=True).over(before) for name in carried} | {f"before_{name}": F.sum(f"of_{name}").over(before) for name in summed}
    left_behind = kept(folded.withColumns(left).drop(*[f"of_{name}" for name in carried | summed]), "left-behind")
    inside = scanned(dealt, ["segment", *keys])
    met = inside.join(_sent(left_behind, 3 * -(-found["rows"] // segment_rows) + found["keys"]), _same(inside, left_behind, ["segment", *keys]), "left")
    whole = {name: F.coalesce(name, f"before_{name}") for name in carried}
    whole |= {name: F.coalesce(F.col(name) + F.col(f"before_{name}"), name, f"before_{name}") for name in summed}
    return cold.unionByName(met.withColumns(whole).select(cold.columns))


def segments(rows: DataFrame, keys: list[str], order: list[str], wanted: int) -> DataFrame:
    """With a ``segment``, growing with ``keys`` and ``order``; twice as many as ``wanted``, as splitters come from samples."""
    return kept(rows.repartitionByRange(2 * wanted, *keys, *order).withColumn("segment", F.spark_partition_id()), "segments")


def row_number(df: DataFrame, keys: list[str], order: list[str], name: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The place of a row among those of its key, from 1, as an int (a key of more than 2**31 rows is an error)."""
    return running(df, keys, order, summed={name: F.lit(1)}, segment_rows=segment_rows).withColumn(name, F.col(name).cast("int"))
