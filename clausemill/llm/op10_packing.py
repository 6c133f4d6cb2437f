"""Hierarchical best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import written

LENGTH = 2048
#: A bin that lacks at most this many tokens is emitted as it is.
SLACK = 8
FAN_IN = 8
#: Bins that a node of the tree packs in one task, about; a node with more is split into parts, each packed whole.
NODE_BINS = 50_000
#: Pieces in order that are packed together where sequences keep an order.
WINDOW = 2048
#: Bits of a piece's number in its place: 2^24 pieces of LENGTH ids are longer than any text.
_PIECE_BITS = 24

_encoders: dict[str, object] = {}


class _Tokens:
    """Ids of the vocabulary that a ``tokenizers`` file (.json) and a ``.tiktoken`` file of the same
    name both hold, exactly as the first one gives them when it is loaded and nothing is set:
    the strings of its special tokens in a text become their ids.  The second, faster, library
    works them out; the first takes texts whose runs of one kind are too long for that,
    and all texts if its added tokens are of kinds that the other does not know."""

    def __init__(self, vocabulary: str, pattern: str):
        import base64
        import json

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._json = vocabulary.removesuffix(".tiktoken") + ".json"
        with open(self._json, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        self._special = {t["content"]: t["id"] for t in added}
        self._fast = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=self._special) if plain else None
        self._slow = None

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a Rust panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._json)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(vocabulary: str, pattern: str) -> _Tokens:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = _Tokens(vocabulary, pattern)
    return _encoders[vocabulary]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fill.

    Items of one size go in the order given.  Open bins are kept by what they
    have left, the tightest that fits is found by a bit mask.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            left[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, place long"


def _pieces(vocabulary: str, pattern: str, length: int, window: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, pattern)
        doc, null, piece, start, size, crc, place = [], [], [], [], [], [], []
        for batch in K.slices(batches, "text"):
            for doc_id, text, position in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.append(tokens(text or ""), 0).astype("<u4")
                raw, at = ids.tobytes(), 0
                to = (len(ids) - 1) % length + 1
                k = 0
                while at < len(ids):
                    doc.append(doc_id or 0)
                    place.append((position or 0) << _PIECE_BITS | k)
                    null.append(doc_id is None)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at, to, k = to, to + length, k + 1
        if not doc:
            return
        sizes = np.array(size, np.int64)
        bins, offsets, full = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
        for at in range(0, len(sizes), window or len(sizes)):
            part = slice(at, at + (window or len(sizes)))
            bins[part], offsets[part], fill = best_fit(sizes[part], length)
            bins[part] += sum(map(len, full))
            full.append(fill)
        fill = np.concatenate(full)
        base = np.int64(TaskContext.get().partitionId()) << 32
        columns = [pa.array(np.array(doc, np.int64), mask=np.array(null)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(bins + base), pa.array(offsets), pa.array(fill[bins]), pa.array(place, pa.int64())]
        whole = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECES.split(", ")])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return run


def _merge(length: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[True, True])
        # a number of its own for each bin: level, node, part, place
        base = (np.int64(level) << 58) | (np.int64(pdf["grp"].iloc[0]) << 34) | (np.int64(pdf["part"].iloc[0]) << 20)
        bins, offsets, fill = best_fit(pdf["fill"].to_numpy(), length)
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "parent": bins + base, "shift": offsets, "fill": fill[bins], "grp": pdf["grp"].to_numpy()})

    return run


def best_fit_packed(docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, position_col: str | None = None, window: int = WINDOW, node_bins: int = NODE_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Each text's ids are followed by id 0.  Longer ones are cut into pieces of
    length ids; the first piece takes the remainder.  A partition packs its pieces
    best-fit; bins that are nearly full are done, the others go up a tree (FAN_IN
    partitions to a node) as items of what they hold, and are packed again.  A
    node with more than node_bins of them is split by hash into parts of about that
    many, each packed whole, so no task grows with the input and no bin is left out.

    With position_col (whole numbers, each row its own, by which docs' partitions
    and their rows are sorted) sequences keep that order: pieces are packed in windows
    of so many, and a sequence's id grows with the least position in it.  Only
    bins that are not full leave their window.

    A null text counts as empty, an empty one is a single id 0.  Repeated rows
    are packed each; a null doc_id stays null.  Other columns are ignored; an
    empty table gives an empty result.  vocabulary is a ``.tiktoken`` file that
    every executor can open, pattern its split pattern; the ``tokenizers`` file (.json)
    of the same name lies beside it, and ids are that file's as it is loaded.
    """
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(position_col) if position_col else F.lit(None)).cast("long").alias("position"))
    pieces = written(source.mapInArrow(_pieces(str(vocabulary), pattern, length, window if position_col else None), _PIECES), "pieces")
    open_ = pieces.where(F.col("fill") < length - SLACK).groupBy("bin").agg(F.first("fill").alias("fill")).withColumn("grp", F.shiftright("bin", 32))
    most = pieces.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    moved = None  # bin -> where it now lies
    level = 0
    while most > 0:
        level, most = level + 1, most // FAN_IN
        nodes = open_.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long"))
        parts = nodes.groupBy("grp").agg(F.ceil(F.count("*") / node_bins).alias("parts"))  # a row for each node
        nodes = nodes.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("bin"), F.col("parts"))).drop("parts")
        merged = nodes.groupBy("grp", "part").applyInPandas(_merge(length, level), "bin long, parent long, shift long, fill long, grp long")
        merged = written(merged, "merged")
        step = merged.select("bin", "parent", "shift")
        if moved is None:
            moved = step
        else:
            up = step.select(F.col("bin").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            moved = moved.join(up, "parent", "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        open_ = merged.where(F.col("fill") < length - SLACK).groupBy(F.col("parent").alias("bin")).agg(F.first("fill").alias("fill"), F.first("grp").alias("grp"))
    out = pieces
    if moved is not None:
        out = pieces.join(moved, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("parent", "bin"))
    if position_col:
        least = out.groupBy("bin").agg(F.min("place").alias("least"))
        out = out.join(least, "bin").withColumn("bin", F.col("least"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
