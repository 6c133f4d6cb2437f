"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of fixed row count.  With weight w, its j-th
block (from 0) of a phase is released at slot floor(j / w) and due at
ceil((j + 1) / w); in each slot the released block with the earliest deadline
runs.  As weights sum to one and jobs are of unit length, every block meets its
deadline, so after any number of slots each source has had its share to within
less than one block.  A phase ends when a source runs out; the weights of those
left are scaled up and a new phase begins.

Releases and deadlines come from the exact weights, as ratios of integers.  The
driver schedules every block and sends the blocks' places to the tasks in stretches
of PERIOD; every document looks up its slot in them.  A block has BLOCK_ROWS rows,
or as many as keep the schedule within MOST_BLOCKS blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

PERIOD = 5000
#: Rows of a block at least, and the blocks that the driver schedules at most: with more
#: rows than fill so many, blocks grow in proportion.
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 20
#: Rows that are numbered in one task, about: the hashed order of a source is cut into ranges of so many.
RANGE_ROWS = 1 << 14


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[dict]:
    """Per phase: first slot, a period that no phase exceeds and that is period at least, each source's places in it.

    A source's blocks take its places of all phases in turn.
    """
    left = {k: n for k, n in blocks.items() if n}
    exact = {k: Fraction(weights[k]) for k in left}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    share = {k: int(x * scale) for k, x in exact.items()}
    # first blocks are due in this order in every phase, so none of them need be listed anew
    heads = sorted(left, key=lambda k: (-share[k], k))
    total, out, begin = sum(share.values()), [], 0
    while left:
        if len(heads) > 2 * len(left):
            heads = [k for k in heads if k in left]
        released: list[tuple[int, str, int]] = []
        waiting: list[tuple[int, str, int]] = []
        places: dict[str, list[int]] = {}
        at = t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, k, j = heapq.heappop(waiting)
                heapq.heappush(released, (-(-(j + 1) * total // share[k]), k, j))
            while at < len(heads) and heads[at] not in left:
                at += 1
            if at < len(heads) and (not released or (-(-total // share[heads[at]]), heads[at], 0) < released[0]):
                k, j, at = heads[at], 0, at + 1
            else:
                _, k, j = heapq.heappop(released)
            places.setdefault(k, []).append(t)
            t += 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(waiting, ((j + 1) * total // share[k], k, j + 1))
        del left[k]
        total -= share[k]
        out.append({"begin": begin, "period": max(period, t), "places": places})
        begin += t
    return out


def square_root_weights(counts: Mapping[str, int]) -> dict[str, float]:
    """Between equal shares and shares by size."""
    return {k: math.sqrt(n) for k, n in counts.items()}


def rows_of_a_block(n: int) -> int:
    """For n rows: BLOCK_ROWS, or more where these would make more than MOST_BLOCKS blocks."""
    return max(BLOCK_ROWS, -(-n // MOST_BLOCKS))


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, id_col: str, source_col: str, block_rows: int | None, period: int) -> DataFrame:
    """_row (docs' columns), _source, _slot, _position; see mixed()."""
    ident, name = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    totals = {r[0]: r[1] for r in docs.groupBy(name).count().collect()}  # a row for each source
    block_rows = block_rows or rows_of_a_block(sum(totals.values()))
    # the hash's highest bits, as many as cut the largest source into ranges of RANGE_ROWS; in unsigned order
    bits = max(1, (max(totals.values(), default=1) // RANGE_ROWS).bit_length())
    h = F.xxhash64(ident.cast("long"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), ident.alias("_id"), name.alias("_source"), h.alias("_h"), F.shiftrightunsigned(h, 64 - bits).alias("_range"))
    counts = written(keyed.groupBy("_source", "_range").agg(F.count("*").alias("c")), "counts")
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    bases = counts.select("_source", "_range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_range").orderBy("_h", F.col("_id").asc_nulls_first(), F.xxhash64("_row"))
    ranked = keyed.withColumn("_rn", F.row_number().over(inside)).join(bases, ["_source", "_range"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_rn") - 1)
    target = dict(weights) if weights is not None else square_root_weights(totals)
    groups = [{k: n for k, n in totals.items() if target.get(k, 0) > 0}, {k: n for k, n in totals.items() if target.get(k, 0) <= 0}]
    slots: dict[str, list[int]] = {k: [] for k in totals}
    begin = 0
    for group in groups:
        blocks = {k: -(-n // block_rows) for k, n in group.items()}
        for phase in phases(blocks, {k: target.get(k, 0) if target.get(k, 0) > 0 else 1.0 for k in group}, period):
            for k, places in phase["places"].items():
                slots[k].extend(begin + phase["begin"] + s for s in places)
        begin += sum(blocks.values())
    # a source's last block may be short: later places move up by what it lacks
    size = np.full(begin, block_rows, np.int64)
    for k, n in totals.items():
        size[slots[k][-1]] -= -n % block_rows
    starts = np.cumsum(size) - size
    rows = [(k, at // period, s[at : at + period], starts[s[at : at + period]].tolist()) for k, s in slots.items() for at in range(0, len(s), period)]
    # two numbers for each of at most MOST_BLOCKS blocks and one more for each source
    table = docs.sparkSession.createDataFrame(rows, "_s string, _stretch long, _slots array<long>, _starts array<long>")
    placed = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows))
    placed = placed.join(F.broadcast(table), (F.col("_source") == F.col("_s")) & (F.floor(F.col("_block") / period) == F.col("_stretch")))
    place = F.pmod("_block", F.lit(period)).cast("int") + 1
    placed = placed.withColumn("_slot", F.element_at("_slots", place)).withColumn("_position", F.element_at("_starts", place) + F.pmod("_rank", F.lit(block_rows)))
    return placed.select("_row", "_id", "_source", F.col("_slot").cast("long").alias("_slot"), F.col("_position").cast("long").alias("_position"))


def mixed(docs: DataFrame, *, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """doc_id, source, slot, position of every row of docs: its place in the mixed order.

    weights maps sources to target weights (others, and those of weight 0 or
    less, come after all weighted ones, as an equal mix); None: the square root
    of each source's rows.  Null sources form one source, named ''; it is
    the same as the source ''.  Within a source rows go by hash of the id, then
    id (null first), then hash of the whole row, so the order depends on no
    partition; equal rows take adjacent places.  position has no gaps and starts
    from 0.  An empty table gives an empty result.  block_rows None: see
    rows_of_a_block().  The schedule is made on the driver, which holds two numbers
    for each block; period is how many blocks of a source go to the tasks as one row.
    """
    out = _placed(docs, weights, id_col, source_col, block_rows, period)
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def in_mixed_order(docs: DataFrame, *, text_col: str = "text", weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, period: int = PERIOD, position_col: str | None = None) -> DataFrame:
    """docs with its own columns, sorted over all partitions by the mixed order; with its place in it as position_col, if given.

    There are as many partitions as the texts' bytes fill at the session's
    spark.sql.files.maxPartitionBytes, so that each file is one task's share for the next reader.
    """
    conf = docs.sparkSession._jsparkSession.sessionState().conf()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(max(1, -(-size // conf.filesMaxPartitionBytes())))
    out = _placed(docs, weights, id_col, source_col, block_rows, period)
    return out.repartitionByRange(parts, "_position").sortWithinPartitions("_position").select("_row.*", *([F.col("_position").alias(position_col)] if position_col else []))


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs)
