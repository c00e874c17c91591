"""Mixing sources to target weights by the cube method.

A source's target over its size is a number of copies for each of its documents: the whole part is taken outright and
the fraction is a probability of one copy more. The cube method turns these probabilities into 0 or 1 so that each
source keeps both its expected words and its expected documents: in the flight phase, three probabilities at a time
move along the null space of the two balancing equations until one of them lands. The flight runs in blocks of a
source's rows; a block leaves two probabilities undecided at most, which go on to the next, smaller round, until one
block per source is left and its last two land on the choice that misses the target least.

The table of sources stays distributed, whatever their number: they are ranked by a range shuffle, and the level up to
which weights are filled is found by sums over them, one row a round to the driver. Documents meet their source in a
join, which Spark sends to every task only below its own size limit.

Null texts have size 0. Null is a source of its own, which comes last. Repeated ids stay separate rows. A source of
size 0 gets target 0 and nothing is taken. An empty table gives no rows. Columns other than id, text and source are
not read. Every draw comes from the ids, sources and texts of rows, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm._common import stored, workspace

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096
MOST_COPIES = 3.0
ALIKE_SHARE = 1000
LANDED = 1e-9


def ranked_sources(sizes: DataFrame, weights: Sequence[float], folder: str) -> DataFrame:
    """(source, n, source_size, weight) of sources in order of code points, null last, with the weights in turn.

    Places are counted inside the partitions of a range shuffle; the counts of the partitions before are added.
    """
    ranges = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    ranges = stored(ranges.withColumn("part", F.spark_partition_id()), "ranges", folder)
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    counts = ranges.groupBy("part").count()  # one row a partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("inside", inside).join(counts.select("part", before.alias("before")), "part")
    turn = F.pmod(F.col("before") + F.col("inside"), F.lit(len(weights))).cast("int")
    return placed.select("source", "n", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"))


def fill_level(sources: DataFrame, most: float = MOST_COPIES) -> float:
    """Words to a unit of weight, at which the sources' targets, none above ``most`` times its size, add up to all words.

    Excess of full sources is shared again by weight, so the level rises round by round until no further source is full;
    a round is one aggregation over the sources.
    """
    full = most * F.col("source_size")
    total = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if not total["words"]:
        return 0.0
    level, filled = total["words"] / total["weight"], 0
    while True:
        over = F.col("weight") * F.lit(level) > full
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, full)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r["n"] == filled or not r["open"]:
            return level
        level, filled = (total["words"] - r["given"]) / r["open"], r["n"]


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1; sums of p and of p * size stay as they were."""
    p = p.astype(float).copy()
    open_: list[int] = []
    for i in range(len(p)):
        if LANDED < p[i] < 1 - LANDED:
            open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # Null vector of the rows (1, 1, 1) and (size a, b, c).
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u) if v)
        step = up if draws[i] * (up + down) < down else -down
        for k, v in zip(open_, u):
            p[k] += step * v
        for k in open_:
            p[k] = 0.0 if p[k] <= LANDED else 1.0 if p[k] >= 1 - LANDED else p[k]
        open_ = [k for k in open_ if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last undecided ones take the values that miss the expected size, then the expected number, least."""
    p = p.copy()
    last = np.flatnonzero((p > LANDED) & (p < 1 - LANDED))
    if len(last):
        want, number = float(p[last] @ size[last]), float(p[last].sum())
        choices = [np.array([(k >> j) & 1 for j in range(len(last))], float) for k in range(1 << len(last))]
        p[last] = min(choices, key=lambda x: (abs(float(x @ size[last]) - want), abs(float(x.sum()) - number)))
    return np.round(p)


def _fly(final: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that what is left to land is small.
        block = block.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
        draws = (block["draw"].to_numpy() % 1_000_003) / 1_000_003
        size = block["size"].to_numpy(float)
        p = flight(block["p"].to_numpy(), size, draws)
        if final:
            p = land(p, size)
        return block.assign(p=p)[["row", "source", "size", "p", "draw", "blocks"]]

    return run


def numbered(rows: DataFrame, alike: list[str], folder: str) -> DataFrame:
    """With a ``number`` from 1 among the rows that agree in ``alike``. They are the same to the mix, so it does not matter which
    has which, and the numbers do not depend on partitions.

    Where more than one row in ``ALIKE_SHARE`` agree, say empty texts without an id, rows are numbered for each ``part`` that
    they came from, behind the counts of the parts before it.
    """
    total, kind = rows.count(), F.xxhash64(*alike)
    hot = stored(rows.groupBy(kind.alias("kind")).count().filter(F.col("count") > max(1, total // ALIKE_SHARE)).select("kind", F.lit(True).alias("hot")), "alike", folder)
    dealt = rows.withColumn("kind", kind).join(F.broadcast(hot), "kind", "left").withColumn("of_part", F.when(F.col("hot"), F.col("part")).otherwise(-1)).drop("hot")
    counts = dealt.filter("of_part >= 0").groupBy("kind", *alike, "of_part").count()  # a row for each kind and part
    earlier = F.sum("count").over(Window.partitionBy("kind", *alike).orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1))
    before = stored(counts.select("kind", F.struct(*alike).alias("same"), "of_part", F.coalesce(earlier, F.lit(0)).alias("before")), "before", folder)
    inside = dealt.withColumn("number", F.row_number().over(Window.partitionBy("kind", *alike, "of_part").orderBy(F.lit(0))))
    of = before.select(F.col("kind").alias("b_kind"), "same", F.col("of_part").alias("b_part"), "before")
    met = inside.join(of, (F.col("kind") == F.col("b_kind")) & (F.col("of_part") == F.col("b_part")) & F.struct(*alike).eqNullSafe(F.col("same")), "left")
    return met.withColumn("number", F.col("number") + F.coalesce("before", F.lit(0))).drop("kind", "of_part", "b_kind", "b_part", "same", "before")


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS, seed: int = 17, key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and row_key with a ``key_col``.

    Sources in order of code points, null last, have ``weights`` in turn. Documents are dealt by source and block.
    """
    with workspace(docs.sparkSession, "mix") as folder:
        return stored(_mixed(docs, weights, id_col, text_col, source_col, block_rows, seed, key_col, folder), "mixed")


def _mixed(docs: DataFrame, weights: Sequence[float], id_col: str, text_col: str, source_col: str, block_rows: int, seed: int, key_col: str | None, folder: str) -> DataFrame:
    carried = [] if key_col is None else ["row_key"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        *([] if key_col is None else [F.col(key_col).cast("string").alias("row_key")]),
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("of_text"), F.spark_partition_id().alias("part"),
    )
    rows = stored(rows, "sizes", folder)
    sources = stored(ranked_sources(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, folder), "sources", folder)
    target = F.least(F.col("weight") * F.lit(fill_level(sources)), MOST_COPIES * F.col("source_size"))
    sources = sources.withColumn("target", target).withColumns({"ratio": F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), "blocks": F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("long")})
    blocks = sources.agg(F.max("blocks").alias("most")).first()["most"] or 0
    whole = rows.join(sources.select(F.col("source").alias("of_source"), "source_size", "target", "ratio", "blocks"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    alike = ["doc_id", "source", "size", "of_text", *carried]
    whole = numbered(whole, alike, folder)
    known = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "size", "of_text", *carried)], F.hex(F.xxhash64("source")), F.col("number").cast("string"))
    whole = whole.withColumn("row", known)
    whole = whole.withColumns({"base": F.floor("ratio"), "p": F.col("ratio") - F.floor("ratio"), "draw": F.xxhash64("row", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))}).drop("of_text", "part", "number")
    whole = stored(whole, "shares", folder)
    now = whole.select("row", "source", "size", "p", "draw", "blocks")
    schema = "row string, source string, size long, p double, draw long, blocks long"
    decided = None
    while blocks:
        flown = now.groupBy("source", F.pmod("draw", "blocks").alias("block")).applyInPandas(_fly(blocks == 1), schema)
        flown = stored(flown, "flight", folder)
        landed = flown.filter((F.col("p") == 0) | (F.col("p") == 1)).select("row", "p")
        decided = landed if decided is None else decided.unionByName(landed)
        if blocks == 1:
            break
        # Two rows a block go on at most.
        now = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("blocks", F.ceil(2 * F.col("blocks") / block_rows).cast("long")).withColumn("draw", F.xxhash64("row", "draw").bitwiseAND(F.lit((1 << 62) - 1)))
        blocks = math.ceil(2 * blocks / block_rows)
    if decided is None:
        return whole.select("doc_id", "source", "size", "source_size", "target", F.col("base").alias("copies"), F.col("base").alias("taken"), *carried)
    out = whole.join(decided.select("row", F.col("p").cast("long").alias("one_more")), "row", "left")
    copies = F.col("base") + F.coalesce("one_more", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carried)
