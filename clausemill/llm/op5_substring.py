"""Paragraphs and passages that repeat across documents, by paragraph MinHash banding.

Paragraphs cover every text.  Each is banded on its min-max signature, verified on
full shingle sets (exact Jaccard) and clustered by components:

* a *line* of PARAGRAPH_WORDS words or more;
* a *stretch* of a run of shorter lines, and of a line of more than LONG_WORDS words: these
  are cut at words chosen by their content, where a shingle's hash is the least of the
  2 * CUT + 1 around it, and two pieces in a row make a stretch, so stretches overlap
  and texts that share a part share its cuts wherever it stands in them.

Besides, equal *passages*: runs of PARAGRAPH_WORDS words that start at an anchor, the least
shingle hash among WINDOW successive ones.  Any shared run of PARAGRAPH_WORDS + WINDOW - 1
words (51) holds a whole passage; equal passages are joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .neardup import clustered, sets_of, signed
from .scratch import discarded, written

#: What counts as a paragraph or passage has so many words.
PARAGRAPH_WORDS, WINDOW = 30, 22
LONG_WORDS, CUT = 150, 16
BANDS, ROWS = 16, 4
#: Bits of the maps that keep unrepeated bands and passages from being shuffled: 16 MB at any input size.
MAP_BITS = 27
#: Band hashes are looked at in 2^PART_BITS parts.
PART_BITS = 8
_NEWLINE = 10
_MOST_BYTES = 2 << 20


def code_points(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Byte positions as code points of their documents."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return (lead[at] - lead[offsets[:-1][doc]]).astype(np.int32)


def anchors(shingle: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the least of some window of successive shingles within a document.

    A shingle equal to the one before does not count, so a run of one word has a single anchor.
    """
    n = len(shingle)
    if n < window:
        return np.empty(0, np.int64)
    rank = shingle.copy()
    repeat = np.zeros(n, bool)
    repeat[1:] = shingle[1:] == shingle[:-1]
    repeat[bounds[:-1][bounds[:-1] < n]] = False
    top = np.uint64(2**64 - 1)
    rank[repeat] = top
    least = _sliding(rank, window, np.minimum)
    # windows that cross documents count for none
    first = np.arange(n - window + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least[doc[first] != doc[first + window - 1]] = 0
    # the greatest least of the windows over a place is its own rank, if it is the least of any
    edge = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), window, np.maximum)
    return np.flatnonzero((most == rank) & (rank != top) & (rank != 0))


def cut_points(shingle: np.ndarray, bounds: np.ndarray, reach: int = CUT) -> np.ndarray:
    """Positions that are the least of all within reach of them, within a region; more than reach apart."""
    window = 2 * reach + 1
    if len(shingle) < window:
        return np.empty(0, np.int64)
    first = np.arange(len(shingle) - window + 1)
    region = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero((_sliding(shingle, window, np.minimum) == shingle[reach : len(shingle) - reach]) & (region[first] == region[first + window - 1])) + reach
    # of equal ones in reach of each other the first
    return at[np.concatenate(([True], (np.diff(at) > reach) | (region[at[1:]] != region[at[:-1]])))] if len(at) else at


def _sliding(x: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of x, by windows of doubled length."""
    size, out = 1, x
    while size * 2 <= window:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - window + 1], out[window - size : window - size + len(x) - window + 1])


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends (bytes) and hashes, and each paragraph's document, first word, word after it, and whether it is a line."""
    cut = np.union1d(offsets, np.flatnonzero(data == _NEWLINE) + 1)
    starts, ends, bounds = K.word_spans(data, cut)
    hashed = K.hash_words(data, starts, ends)
    count = np.diff(bounds)
    line = np.flatnonzero(count >= PARAGRAPH_WORDS)
    # regions to cut: each long line, and each run of lines that are no paragraphs
    n = len(count)
    new_text = np.zeros(n + 1, bool)
    new_text[np.searchsorted(cut, offsets)] = True
    is_line = np.concatenate((count >= PARAGRAPH_WORDS, [True]))
    begins = np.flatnonzero(~is_line[:-1] & (np.concatenate(([True], is_line[:-2])) | new_text[:-1])) if n else np.empty(0, np.int64)
    stops = np.flatnonzero(is_line | new_text)
    after = stops[np.searchsorted(stops, begins, "right")] if len(begins) else begins
    long_ = np.flatnonzero(count > LONG_WORDS)
    lo, hi = np.concatenate((bounds[begins], bounds[long_])), np.concatenate((bounds[after], bounds[long_ + 1]))
    some = hi - lo >= PARAGRAPH_WORDS
    lo, hi = lo[some], hi[some]
    whole = np.concatenate((np.zeros(len(begins), bool), np.ones(len(long_), bool)))[some]  # the region is a line
    inside = np.concatenate(([0], np.cumsum(hi - lo)))
    word = np.repeat(lo - inside[:-1], hi - lo) + np.arange(inside[-1])
    shingle, cuts = K.shingles(hashed[word], inside)
    at = cut_points(shingle, cuts)
    # pieces of each region: from its begin and each cut; two in a row make a stretch
    region = np.searchsorted(cuts[1:], at, "right")
    place = np.concatenate((lo, lo[region] + at - cuts[region]))
    owner = np.concatenate((np.arange(len(lo)), region))
    order = np.lexsort((place, owner))
    place, owner = place[order], owner[order]
    fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))) if len(place) else np.empty(0, bool)
    place, owner = place[fresh], owner[fresh]
    pieces = np.bincount(owner, minlength=len(lo)) if len(owner) else np.zeros(len(lo), np.int64)
    first = np.concatenate(([0], np.cumsum(pieces)))[:-1] if len(lo) else np.empty(0, np.int64)
    k = np.arange(len(place)) - first[owner] if len(place) else np.empty(0, np.int64)
    later = np.minimum(np.arange(len(place)) + 2, len(place) - 1)
    stop = np.where(k + 2 < pieces[owner], place[later], hi[owner]) if len(place) else np.empty(0, np.int64)
    # the last piece alone is the tail of the stretch before it; a line that is one stretch is there already
    keep = ((k == 0) | (k + 1 < pieces[owner])) & (stop - place >= PARAGRAPH_WORDS) & ~(whole[owner] & (pieces[owner] <= 2)) if len(place) else np.empty(0, bool)
    a, b = np.concatenate((bounds[line], place[keep])), np.concatenate((bounds[line + 1], stop[keep]))
    doc = np.searchsorted(offsets[1:], starts[a], "right") if len(a) else np.empty(0, np.int64)
    return starts, ends, hashed, doc, a, b, np.arange(len(a)) < len(line)


def _paragraphs(batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The paragraphs: doc_id, line, start, end in code points; their distinct shingles."""
    data, offsets = K.flat(batch.column("text"))
    starts, ends, hashed, doc, a, b, line = paragraphs(data, offsets)
    inside = np.concatenate(([0], np.cumsum(b - a)))
    word = np.repeat(a - inside[:-1], b - a) + np.arange(inside[-1])
    values, sets = K.distinct(*K.shingles(hashed[word], inside))
    ids = batch.column("doc_id").take(pa.array(doc))
    first, last = (starts[a], ends[b - 1]) if len(a) else (np.empty(0, np.int64), np.empty(0, np.int64))
    return [ids, pa.array(line), pa.array(code_points(data, offsets, first, doc)), pa.array(code_points(data, offsets, last, doc))], values, sets


def _passages(batch: pa.RecordBatch, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Hash and document of each passage; with wanted, of those whose hash it picks, also a second hash, start and end in code points."""
    data, offsets = K.flat(batch.column("text"))
    starts, ends, bounds = K.word_spans(data, offsets)
    hashed = K.hash_words(data, starts, ends)
    shingle, cut = K.shingles(hashed, bounds)
    at = anchors(shingle, cut)
    doc = np.searchsorted(cut[1:], at, "right")
    word = at - cut[doc] + bounds[doc]
    inside = word + PARAGRAPH_WORDS <= bounds[doc + 1]
    word, doc = word[inside], doc[inside]

    def summed(salt: int) -> np.ndarray:
        out = np.zeros(len(word), np.uint64)
        with np.errstate(over="ignore"):
            for j, p in enumerate(K.constants(PARAGRAPH_WORDS, salt)):
                out += hashed[word + j] * p
        return K.mix64(out)

    one = summed(0x501)
    if wanted is None:
        return one, doc
    hit = wanted(one)
    one, word, doc = one[hit], word[hit], doc[hit]
    return one, doc, summed(0x502), code_points(data, offsets, starts[word], doc), code_points(data, offsets, ends[word + PARAGRAPH_WORDS - 1], doc)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text", _MOST_BYTES):
        one, doc = _passages(batch)
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), batch.column("doc_id").take(pa.array(doc))], ["h", "doc_id"])


def _map_of(hashes: DataFrame) -> bytes:
    """A bitmap of the top MAP_BITS bits of the hashes."""
    x = F.shiftrightunsigned("h", 64 - MAP_BITS) + 1
    got = hashes.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for k, bits in got.toLocalIterator():  # at most 4096 rows of 4 kB
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)

        def wanted(one: np.ndarray) -> np.ndarray:
            x = (one >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            return np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1)

        for batch in K.slices(batches, "text", _MOST_BYTES):
            one, doc, two, start, end = _passages(batch, wanted)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(end)], ["h", "h2", "doc_id", "start", "end"])

    return run


def repeated_passages(source: DataFrame) -> DataFrame:
    """doc_id, start, end, component_id, removed: equal passages of two or more documents, overlapping ones as one row."""
    seen = source.mapInArrow(_hashes, "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    wanted = written(seen.where("lo < hi").select("h"), "wanted")
    shared = source.sparkSession.sparkContext.broadcast(_map_of(wanted))
    found = source.mapInArrow(_found(shared), "h long, h2 long, doc_id long, start int, end int")
    found = written(found.join(wanted, "h", "left_semi"), "found")
    first = found.groupBy("h", "h2").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("hi")).where("component_id < hi").drop("hi")
    # written, so that the join that follows deals both sides anew and a hot passage's rows can be split
    first = written(first, "first")
    rows = found.join(first, ["h", "h2"]).select("doc_id", "start", "end", "component_id", (F.col("doc_id") != F.col("component_id")).alias("removed"))
    order = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "removed", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("component_id").alias("component_id")).select("doc_id", "start", "end", "component_id", "removed")


def _band_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band hashes without their rows: by their top PART_BITS bits, the next 32 bits of each, packed."""
    for batch in batches:
        bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        bands = np.sort(bands)
        cut = np.searchsorted((bands >> np.uint64(64 - PART_BITS)).astype(np.int64), np.arange((1 << PART_BITS) + 1))
        short = ((bands >> np.uint64(32 - PART_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        parts = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([short[cut[k] : cut[k + 1]].tobytes() for k in parts], pa.binary())], ["part", "held"])


def _often(key: tuple, held: pa.Table) -> pa.Table:
    """A bitmap of those hashes of a part that come twice or more."""
    short = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in held.column("held").to_pylist()]))
    x = short[1:][short[1:] == short[:-1]] >> np.uint32(32 - (MAP_BITS - PART_BITS))
    bits = np.zeros(1 << (MAP_BITS - PART_BITS), bool)
    bits[x] = True
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _met_bands(units: DataFrame) -> DataFrame:
    """cid, n, bands, sig of the units with a band that another unit has; of their bands, those.

    A bitmap of fixed size tells; it passes some bands that nothing else has, and those of
    copies, and loses none.  What is left out can meet nothing, so its rows are not shuffled.
    """
    some = units.where("cid is not null")
    got = some.select("bands").mapInArrow(_band_parts, "part int, held binary").groupBy("part").applyInArrow(_often, "part int, bits binary")
    size = (1 << (MAP_BITS - PART_BITS)) // 8
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for k, bits in got.toLocalIterator():  # at most 256 rows of 64 kB
        out[k * size : (k + 1) * size] = np.frombuffer(bits, np.uint8)
    shared = units.sparkSession.sparkContext.broadcast(out.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            lists = batch.column("bands")
            values = lists.flatten()
            x = (values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            hit = ((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1).astype(bool)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            kept = np.concatenate(([0], np.cumsum(hit)))[ends]
            met = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), values.filter(pa.array(hit)))
            rows = pa.array(np.diff(kept) > 0)
            yield pa.RecordBatch.from_arrays([c.filter(rows) for c in (batch.column("cid"), batch.column("n"), met, batch.column("sig"))], ["cid", "n", "bands", "sig"])

    return some.select("cid", "n", "bands", "sig").mapInArrow(run, "cid binary, n long, bands array<long>, sig binary")


def repeated_paragraphs(source: DataFrame, *, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, kind, start, end, component_id, removed: paragraphs whose component reaches two or more documents."""
    names = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("line", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    units = written(signed(source, "text", _paragraphs, names, BANDS, ROWS), "paragraphs")
    met = _met_bands(units).groupBy("cid").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    met = written(met, "classes")
    places = written(units.select("doc_id", "line", "start", "end", "cid"), "places")
    discarded(units)  # bands and signatures are most of it
    classes = written(places.groupBy("cid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "ranges")
    found = written(clustered(met, lambda wanted: sets_of(source, "text", _paragraphs, wanted), num, den), "clustered")
    homes = classes.select("cid", "lo", "hi").join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ranges = homes.groupBy("comp").agg(F.min("lo").alias("component_id"), F.max("hi").alias("hi")).where("component_id < hi").drop("hi")
    homes = written(homes.select("cid", "comp").join(ranges, "comp").select("cid", "component_id"), "homes")
    discarded(met, classes, found)
    rows = places.join(homes, "cid")
    return rows.select("doc_id", F.when(F.col("line"), "line").otherwise("stretch").alias("kind"), "start", "end", "component_id", (F.col("doc_id") != F.col("component_id")).alias("removed"))


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind (line, stretch or passage), start, end, component_id, removed for each repeated part of a text.

    start and end are code points, end exclusive; component_id is the least
    doc_id of the part's component, whose copy stays; removed marks the others.
    Only parts that occur in two or more documents are returned.  Null and empty
    texts and texts of fewer than PARAGRAPH_WORDS words have no rows; neither have
    rows with a null id.  Repeated rows of one id are one document.  Other
    columns are ignored; an empty table gives an empty result.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = repeated_paragraphs(source).unionByName(repeated_passages(source).withColumn("kind", F.lit("passage")))
    return out.select("doc_id", "kind", "start", "end", "component_id", "removed")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
