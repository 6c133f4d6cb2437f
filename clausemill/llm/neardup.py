"""Exact-threshold clustering of shingle sets, shared by the two near-duplicate operators.

Units (documents, paragraphs) with the same set collapse to one *class* first, so
copies never meet in a join.  Classes are banded on min-max signatures.  In each
bucket the class that collides most elsewhere is the pivot, and every other
member is verified against it on full sets; that links nearly all of a group
without listing its pairs.  Only buckets whose members still lie in different
components go on: small ones list their open pairs, large ones are compared block
by block inside tasks, which emit only the links that join components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .components import connected_components
from .scratch import discarded, written

#: Buckets up to this size list their open pairs; larger ones are compared in blocks.
SMALL_BUCKET = 64
BLOCK = 512
_BITS = 1 << 24
#: Text that is worked on at a time.
_MOST_BYTES = 2 << 20

#: values and offsets of the units' distinct shingles, and the columns that name them
Extract = Callable[[pa.RecordBatch], tuple[list[pa.Array], np.ndarray, np.ndarray]]


def class_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes per set."""
    one, two = K.set_sums(values, bounds)
    out = np.empty((len(one), 2), np.uint64)
    out[:, 0], out[:, 1] = one, two
    return out


def _binary(rows: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)).tobytes())
    mask = None
    if null is not None and null.any():
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [mask, offsets, raw])


def signed(df: DataFrame, text: str, extract: Extract, names: T.StructType, bands: int, rows: int) -> DataFrame:
    """Per unit: its naming columns, n, cid (null for an empty set), bands and sig, a byte of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text, _MOST_BYTES):
            named, values, bounds = extract(batch)
            n = np.diff(bounds)
            if not len(n):
                continue
            full = n > 0
            tight = np.concatenate(([0], np.cumsum(n[full])))
            hashed, short = K.minmax_bands(values, tight, bands, rows) if full.any() else (np.empty((0, bands), np.uint64), np.empty((0, bands * rows), np.uint8))
            sig = np.zeros((len(n), bands * rows), np.uint8)
            sig[full] = short
            ends = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*named, pa.array(n.astype(np.int64)), _binary(class_ids(values, bounds), ~full), lists, _binary(sig)], [*(f.name for f in names), "n", "cid", "bands", "sig"])

    schema = T.StructType([*names, T.StructField("n", T.LongType()), T.StructField("cid", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return df.mapInArrow(run, schema)


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Which of 2^24 values the first three bytes of the wanted ids take: 2 MB at any input size."""
    x = F.conv(F.hex(F.substring("cid", 1, 3)), 16, 10).cast("long") + 1
    got = wanted.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(_BITS // 8, np.uint8)
    for k, bits in got.collect():  # at most 512 rows of 4 kB
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


def sets_of(df: DataFrame, text: str, extract: Extract, wanted: DataFrame) -> DataFrame:
    """(cid, members) of the wanted classes: sorted 64-bit shingle hashes, from the texts again.

    A bitmap of fixed size keeps most other sets from being shuffled; the join
    that follows is exact.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(wanted).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in K.slices(batches, text, _MOST_BYTES):
            _, values, bounds = extract(batch)
            ids = class_ids(values, bounds)
            raw = ids.view(np.uint8).reshape(len(ids), 16)
            x = (raw[:, 0].astype(np.int64) << 16) | (raw[:, 1].astype(np.int64) << 8) | raw[:, 2]
            hit = np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 & (np.diff(bounds) > 0))
            seen: dict[bytes, int] = {}
            for i in hit:
                seen.setdefault(raw[i].tobytes(), int(i))
            if seen:
                sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in seen.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(sets, pa.binary())], ["cid", "members"])

    found = df.mapInArrow(run, "cid binary, members binary").join(wanted, "cid", "left_semi")
    return found.groupBy("cid").agg(F.first("members").alias("members"))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[i] = np.count_nonzero(y[at] == x)
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many bytes of two signatures are equal."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _alike(pairs: DataFrame, sigs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Pairs (a, b and more) without those whose signatures agree too seldom to be linked.

    At the threshold the agreeing values are binomial; the cut lies seven standard
    deviations below their mean, so what it loses is beyond notice, and full sets
    move for promising pairs only.
    """
    t = num / den
    least = t * width - 7 * (width * t * (1 - t)) ** 0.5
    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    return both.where(_agreeing("sa", "sb") >= least).drop("sa", "sb")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) with den * intersection >= num * union, on full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", "na", "nb", _common("ma", "mb").alias("i"))
    return both.where(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num).select("a", "b")


def _blocks(num: int, den: int):
    """Links between components among the sets of one block pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid").reset_index(drop=True)
        comp = pd.factorize(pdf["comp"])[0]
        m = len(pdf)
        if m < 2 or comp.max() == 0:
            return pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object)})
        sets = [np.frombuffer(x, np.uint64) for x in pdf["members"]]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(m), size)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first = np.concatenate(([True], values[1:] != values[:-1]))
        column = np.cumsum(first) - 1
        often = np.bincount(column) > 1
        keep = often[column]
        column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
        common = np.zeros((m, m), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # columns are sorted
            s, e = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((m, width), np.float32)
            part[owner[s:e], column[s:e] - lo] = 1
            common += part @ part.T
        shared = common.astype(np.int64)
        union = size[:, None] + size[None, :] - shared
        link = (shared * den >= union * num) & (comp[:, None] != comp[None, :])
        parent = list(range(comp.max() + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        rows = []
        for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[x] = y
                rows.append((pdf["cid"][i], pdf["cid"][j]))
        return pd.DataFrame(rows, columns=["a", "b"])

    return run


def clustered(classes: DataFrame, find_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(cid, comp) of the classes (cid, n, bands, sig) that have a link; comp is the least cid.

    find_sets gives (cid, members) for a table of cids.
    """
    rows = classes.select("cid", "n", F.explode("bands").alias("bh"))
    multi = rows.groupBy("bh").agg(F.count("*").alias("size")).where("size > 1")
    met = written(rows.join(multi, "bh"), "met")
    wanted = met.select("cid").distinct()
    sets = written(find_sets(wanted), "sets")
    sigs = written(classes.select("cid", "sig").join(wanted, "cid", "left_semi"), "sigs")
    width = (sigs.agg(F.max(F.length("sig"))).first()[0]) or 0
    weight = met.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivot = met.join(weight, "cid").groupBy("bh").agg(F.max(F.struct("weight", "cid", "n")).alias("p"))
    pivot = pivot.select("bh", F.col("p.cid").alias("b"), F.col("p.n").alias("nb"))
    near = f"least(na, nb) * {den} >= greatest(na, nb) * {num}"
    star = met.select("bh", F.col("cid").alias("a"), F.col("n").alias("na")).join(pivot, "bh").where("a <> b").where(near)
    star = _alike(star.select("a", "b", "na", "nb").distinct(), sigs, num, den, width)
    star = written(_verified(star, sets, num, den), "star")
    first = written(connected_components(star), "first")

    homed = met.join(first.select(F.col("node").alias("cid"), "component"), "cid", "left").select("bh", "cid", "n", "size", F.coalesce("component", "cid").alias("comp"))
    mixed = homed.groupBy("bh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bh")
    left = written(homed.join(mixed, "bh"), "mixed")

    small = left.where(F.col("size") <= SMALL_BUCKET)
    x = small.select("bh", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = small.select("bh", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = x.join(y, "bh").where("a < b and ca <> cb").where(near).select("a", "b", "na", "nb").distinct()
    more = _verified(_alike(pairs, sigs, num, den, width), sets, num, den)

    large = left.where(F.col("size") > SMALL_BUCKET)
    dealt = large.select("bh", "cid", "comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("bh", "cid", "comp", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j")).join(sets, "cid")
    more = more.unionByName(dealt.groupBy("bh", "i", "j").applyInPandas(_blocks(num, den), "a binary, b binary"))
    links = written(star.unionByName(more), "links")
    discarded(met, sets, sigs, star, first, left)
    return connected_components(links).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
