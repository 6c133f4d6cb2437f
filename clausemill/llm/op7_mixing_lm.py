"""Language-model scores by logistic context mixing of bit predictors of contexts.

A text is its lower-cased bytes and an end mark.  Each byte is predicted bit by
bit, most significant first.  For each order from 0 to ORDERS - 1 the zeros and ones
that followed the preceding bytes and the bits so far are counted over all training
texts.  The orders' predictions are mixed in the logistic domain with
weights chosen by a gate (how much each of the two longest contexts has been seen,
and the bit's place), learnt online; an adaptive map then refines the mix.

The corpus is gathered as distinct n-grams with counts, which grow with it.  Dealt by
the two bytes before the last one, they give the exact counts of every context of
two bytes and more; those of shorter ones are sums over pairs of bytes.  The mixer is
trained on the n-grams, every occurrence predicted with its own count taken out; each
n-gram's two scores, by all orders and by the low ones alone, are computed once and joined
to the blocks of text that hold it.  Along each text the two are mixed again, online:
their weights follow how well they have foretold the text so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import discarded, written

ORDERS = 5
FOLDS, HELD = 7, 2
_SPAN = ORDERS  # bytes of an n-gram: the longest context and the byte itself
_GATES = 8 * 4 * 4
_BUCKETS = 33
#: Bytes of text that are worked on at a time, and of a block.
_PIECE, _BLOCK = 1 << 20, 16 << 20
_END = 0
#: Bytes of a segment of a text; the full model's weight at first; the share of weight that changes sides after each segment.
SEGMENT, FULL_FIRST, SWITCH = 64, 0.9, 0.02
COUNT_PART = 1 << 24


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each byte and at each text's end mark, and their n+1 offsets.

    Before a text's first byte stand zero bytes.
    """
    n = len(offsets) - 1
    pad = _SPAN - 1
    starts = offsets[:-1] + (pad + 1) * np.arange(n) + pad
    padded = np.zeros(len(data) + (pad + 1) * n, np.uint8)
    place = np.arange(len(data)) + np.repeat((pad + 1) * np.arange(n) + pad, np.diff(offsets))
    padded[place] = np.maximum(K._LOWER[data], 1)
    key = np.zeros(len(padded), np.uint64)
    for j in range(_SPAN):
        key[j:] |= padded[: len(padded) - j].astype(np.uint64) << np.uint64(8 * j)
    keep = np.ones(len(padded), bool)
    for j in range(pad):
        keep[starts - pad + j] = False
    return key[keep], offsets + np.arange(n + 1)


def _bits(keys: np.ndarray) -> np.ndarray:
    """The bits (8 x keys) of each key's last byte."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    return np.stack([(byte >> (7 - b)) & 1 for b in range(8)]).astype(np.int8)


def _stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + np.float32(0.02)) / (zero + np.float32(0.02)))


class Mixer:
    """Gated weights (gates x orders) and the adaptive map (gates x buckets)."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((_GATES, ORDERS), 1.2 / ORDERS, np.float32) if weights is None else weights
        #: logit of the refined probability at each bucket of the mix's logit
        self.refine = np.tile(np.linspace(-8, 8, _BUCKETS, dtype=np.float32), (_GATES, 1)) if refine is None else refine

    @staticmethod
    def gates(seen: np.ndarray) -> np.ndarray:
        """seen: counts (orders x 8 x n) -> gate (8 x n)."""
        level = lambda c: np.minimum(3, np.log2(c + 1).astype(np.int32) // 3)
        return np.arange(8)[:, None] * 16 + level(seen[-1]) * 4 + level(seen[-2])

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = np.zeros(gate.shape, np.float32)
        for o in range(ORDERS):
            out += self.weights[gate, o] * inputs[o]
        return np.clip(out, -12, 12)

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        place = (np.clip(logit, -7.999, 7.999) + 8) * ((_BUCKETS - 1) / 16)
        low = place.astype(np.int32)
        part = place - low
        mapped = self.refine[gate, low] * (1 - part) + self.refine[gate, low + 1] * part
        return np.float32(0.5) * (logit + mapped)


def _logs(got: np.ndarray, bits: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 probability of the bytes that bits (8 x n) make up, from counts (orders x 8 x n x 2)."""
    gate = mixer.gates(got.sum(axis=3))
    logit = mixer.refined(mixer.mixed(_stretch(got[..., 0], got[..., 1]), gate), gate)
    return -np.logaddexp(0, np.where(bits == 1, -logit, logit).astype(np.float64)).sum(axis=0) / np.log(10)


def low_order(got: np.ndarray) -> np.ndarray:
    """Counts (orders x 8 x n x 2) as if no context of three bytes or more had been seen."""
    out = got.copy()
    out[3:] = 0
    return out


def adaptive_scores(full: np.ndarray, low: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """log10 probability of each text from that of its bytes by two models; a text's bytes are cut[i] to cut[i + 1].

    Along a text, segment by segment (SEGMENT bytes), the two are mixed by weights
    that follow how well each has foretold the text so far; SWITCH of the weight
    changes sides after each segment, so the mix keeps up with a text that changes.
    """
    n = len(cut) - 1
    pieces = -(-np.diff(cut) // SEGMENT)
    order = np.argsort(-pieces, kind="stable")
    first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    starts = np.repeat(cut[:-1], pieces) + SEGMENT * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    a, b = (np.add.reduceat(x, starts) * np.log(10) if len(starts) else np.zeros(0) for x in (full, low))
    out, weight = np.zeros(n), np.full(n, FULL_FIRST)
    live = np.searchsorted(-pieces[order], -np.arange(1, int(pieces.max(initial=0)) + 1), "right")  # texts with more than k segments
    for k, m in enumerate(live.tolist()):
        text = order[:m]
        x, y = a[first[text] + k], b[first[text] + k]
        top = np.maximum(x, y)
        p, q = weight[text] * np.exp(x - top), (1 - weight[text]) * np.exp(y - top)
        out[text] += top + np.log(p + q)
        weight[text] = SWITCH + (1 - 2 * SWITCH) * p / (p + q)
    return out / np.log(10)


def _shared(values: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts (9 x n) of what shares each value's context and the first 0 to 8 bits of its last byte."""
    order = np.argsort(values)
    v, n = values[order], c[order]
    out = np.empty((9, len(v)), np.float32)
    for b in range(9):
        part = v >> np.uint64(8 - b)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out[b, order] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(v))))
    return out


def _of_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """_shared() from the counts of all values."""
    return np.stack([table.reshape(-1, 1 << (8 - b)).sum(axis=1)[(values >> np.uint64(8 - b)).astype(np.int64)] for b in range(9)]).astype(np.float32)


def exact_counts(keys: np.ndarray, c: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, their own counts, zeros and ones (orders x 8 x n x 2) of their contexts and their bits, piece by piece.

    keys are all n-grams of their last two context bytes; pairs counts all pairs of bytes.
    """
    group = K.mix64((keys >> np.uint64(8)) & np.uint64(0xFFFF))
    order = np.argsort(group)
    keys, c, group = keys[order], c[order], group[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(keys)) if len(keys) else [0]
    lo = 0
    for hi in edges[1:]:
        if hi - lo < 1 << 16 and hi < len(keys):
            continue
        k, n = keys[lo:hi], c[lo:hi]
        mixed = np.argsort(K.mix64(k))  # no context's n-grams are learnt in a row
        k, n, lo = k[mixed], n[mixed], hi
        long_ = [_shared(k & np.uint64((1 << (8 * (o + 1))) - 1), n) for o in range(2, ORDERS)]
        for at in range(0, len(k), 1 << 15):
            part = slice(at, at + (1 << 15))
            totals = [_of_table(pairs.reshape(256, 256).sum(axis=0), k[part] & np.uint64(0xFF)), _of_table(pairs, k[part] & np.uint64(0xFFFF)), *(x[:, part] for x in long_)]
            bits = _bits(k[part])
            got = np.empty((ORDERS, *bits.shape, 2), np.float32)
            for o, total in enumerate(totals):
                own, other = total[1:], total[:-1] - total[1:]
                got[o, ..., 0], got[o, ..., 1] = np.where(bits == 0, own, other), np.where(bits == 1, own, other)
            yield k[part], n[part], got, bits


def _dealt(grams: DataFrame) -> DataFrame:
    """The n-grams of two last context bytes in one partition, for exact_counts()."""
    return grams.repartition(F.shiftright("key", 8).bitwiseAND(0xFFFF))


def _whole(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    got = [(b.column("key").to_numpy().view(np.uint64), b.column("c").to_numpy()) for b in batches]
    if got:
        yield from exact_counts(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]), pairs)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and n-grams of each block with their count in training texts."""
    words: list[tuple[np.ndarray, np.ndarray]] = []
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    block = None
    for whole in batches:
        blocks = whole.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
            for batch in K.slices(iter([whole.slice(lo, hi - lo)]), "text", _PIECE):
                if block is not None and block != blocks[lo]:
                    yield from _counted(0, block, words)
                    yield from _counted(1, block, grams)
                    words, grams = [], []
                block = blocks[lo]
                train = ~np.array(batch.column("held_out").to_pylist(), bool)
                data, offsets = K.flat(batch.column("text"))
                starts, ends, bounds = K.word_spans(data, offsets)
                hashed = K.hash_words(data, starts, ends).view(np.int64)
                of_train = np.repeat(train, np.diff(bounds))
                words.append(_summed([(hashed, of_train.astype(np.int64))]))
                keys, cut = ngrams(data, offsets)
                both, n = np.unique((keys.view(np.int64) << 1) | np.repeat(train, np.diff(cut)), return_counts=True)
                grams.append((both >> 1, n * (both & 1)))
                if sum(len(k) for k, _ in grams) > 1 << 21:
                    grams = [_summed(grams)]
                    if len(grams[0][0]) > 1 << 20:  # what is emitted in parts is summed later
                        yield from _counted(1, block, grams)
                        grams = []
    yield from _counted(0, block, words)
    yield from _counted(1, block, grams)


def _counted(kind: int, block: int | None, heap: list) -> Iterator[pa.RecordBatch]:
    if not heap:
        return
    keys, counts = _summed(heap)
    for at in range(0, len(keys), 50_000):
        k, c = keys[at : at + 50_000], counts[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(np.full(len(k), block, np.int64)), pa.array(k), pa.array(c)], ["kind", "block", "key", "c"])


def _summed(heap: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in heap]), np.concatenate([c for _, c in heap])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def pair_counts(grams: DataFrame) -> np.ndarray:
    """Counts of all pairs of bytes that end an n-gram."""
    got = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("c").alias("c")).toArrow()  # at most 65,536 rows
    out = np.zeros(1 << 16, np.int64)
    out[got.column("pair").to_numpy()] = got.column("c").to_numpy()
    return out


def _train(pairs: np.ndarray):
    """One partition's online pass; what it has learnt, weighed by the bits it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, hits, squares = Mixer(), np.zeros((_GATES, _BUCKETS, 2)), np.full((_GATES, ORDERS), 1e-3)
        seen_bits = 0.0
        for keys, n, all_counts, all_bits in _whole(batches, pairs):
            for at in range(0, len(keys), 256):
                bits, got = all_bits[:, at : at + 256], all_counts[:, :, at : at + 256].copy()
                weight = np.broadcast_to(n[at : at + 256].astype(np.float32), bits.shape)
                # its own count out: what is left is what other occurrences say
                got -= np.stack([bits == 0, bits == 1], -1)[None]
                got = np.maximum(got, 0)
                gate = mixer.gates(got.sum(axis=3))
                inputs = _stretch(got[..., 0], got[..., 1])
                logit = mixer.mixed(inputs, gate)
                error = (bits - 1 / (1 + np.exp(-logit))) * weight
                total = np.bincount(gate.reshape(-1), weight.reshape(-1), _GATES)
                for o in range(ORDERS):
                    slope = np.bincount(gate.reshape(-1), (error * inputs[o]).reshape(-1), _GATES) / np.maximum(total, 1)
                    squares[:, o] += slope * slope
                    mixer.weights[:, o] += (0.03 * slope / np.sqrt(squares[:, o])).astype(np.float32)
                bucket = np.rint((np.clip(logit, -8, 8) + 8) * ((_BUCKETS - 1) / 16)).astype(np.int64)
                np.add.at(hits, (gate, bucket, bits), weight)
                seen_bits += float(weight.sum())
        if seen_bits:
            payload = np.concatenate([mixer.weights.reshape(-1) * seen_bits, hits.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array([seen_bits]), pa.array([payload.tobytes()], pa.binary())], ["bits", "payload"])

    return run


def _sum_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, total = 0.0, None
    for batch in batches:
        for b, p in zip(batch.column("bits").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            part = np.frombuffer(p)
            bits, total = bits + b, part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([bits]), pa.array([total.tobytes()], pa.binary())], ["bits", "payload"])


def train_mixer(grams: DataFrame, pairs: np.ndarray) -> Mixer:
    """The average of the partitions' mixers, and their adaptive maps' counts together."""
    learnt = _dealt(grams.where("c > 0")).mapInArrow(_train(pairs), "bits double, payload binary")
    # in two steps, so that the driver gets at most 16 payloads of 73 kB
    rows = learnt.repartition(16, F.xxhash64("payload")).mapInArrow(_sum_payloads, "bits double, payload binary").collect()
    if not rows:
        return Mixer()
    bits, total = sum(r[0] for r in rows), np.sum([np.frombuffer(r[1]) for r in rows], axis=0)
    cut = _GATES * ORDERS
    hits = total[cut:].reshape(_GATES, _BUCKETS, 2)
    start = np.linspace(-8, 8, _BUCKETS)
    prior = 1 / (1 + np.exp(-start))
    p = (hits[..., 1] + 8 * prior) / (hits.sum(axis=2) + 8)
    return Mixer((total[:cut] / bits).reshape(_GATES, ORDERS).astype(np.float32), np.log(p / (1 - p)).astype(np.float32))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _gram_scores(pairs: np.ndarray, mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, got, bits in _whole(batches, pairs):
            values = [pa.array(_logs(x, bits, mixer).astype(np.float32)) for x in (got, low_order(got))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *values], ["key", "value", "low"])

    return run


def _scored(tokens: int, distinct: int, ends: int):
    def run(docs: pa.Table, vocabulary: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, key, value, low = (vocabulary.column(x).to_numpy() for x in ("kind", "key", "value", "low"))
        order = np.argsort(key)
        word, gram = order[kind[order] == 0], order[kind[order] == 1]
        known, grams, logs, lows = key[word], key[gram], value[gram], low[gram]
        c = value[word].astype(np.float64) + low[word].astype(np.float64) * COUNT_PART
        base = tokens + distinct + 1.0
        for batch in K.slices(iter(docs.to_batches()), "text", _PIECE):
            data, offsets = K.flat(batch.column("text"))
            starts, stops, bounds = K.word_spans(data, offsets)
            hashed = K.hash_words(data, starts, stops).view(np.int64)
            count = c[np.searchsorted(known, hashed)] if len(hashed) else np.zeros(0)
            part = lambda x, b: np.diff(np.concatenate(([0.0], np.cumsum(x)))[b])
            n = np.diff(bounds)
            base_score = part(np.log10((count + 1) / base), bounds) + np.log10((ends + 1) / base)
            n_known = np.diff(np.concatenate(([0], np.cumsum(count > 0)))[bounds]) + (ends > 0)
            keys, cut = ngrams(data, offsets)
            at = np.searchsorted(grams, keys.view(np.int64))
            score = adaptive_scores(logs[at].astype(np.float64), lows[at].astype(np.float64), cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), pa.array(n_known.astype(np.int64)), pa.array(base_score), pa.array(score), pa.array(np.diff(cut))],
                names.names,
            )

    names = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def table(docs: pa.Table, vocabulary: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(docs, vocabulary)), names)

    return table


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the stretches of at most _BLOCK bytes of text, which later are scored each with its own vocabulary."""
    base = TaskContext.get().partitionId() << 32  # the table is written at once: what is read later keeps its number
    for k, batch in enumerate(K.slices(batches, "text", _BLOCK)):
        yield batch.append_column("block", pa.array(np.full(batch.num_rows, base + k, np.int64)))


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    Learns from all rows that are not held out.  Tokens are words with A-Z
    lower-cased, then one end; they are compared by 64-bit hashes.  base_score is
    the add-one unigram sum; score the mixing model's log10 probability of the
    lower-cased bytes and the end mark (two models' mix, see adaptive_scores()),
    bits_per_byte that in bits for each of them.  A null text counts as empty: one token, the end.  A null id is never
    held out.  Repeated rows count and are scored each.  Zero bytes are read as
    ones.  Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("held_out", held_out(F.col("doc_id")))
    source = written(source.mapInArrow(_blocks, "doc_id long, text string, held_out boolean, block long"), "blocks")
    gathered = written(source.mapInArrow(_gathered, "kind byte, block long, key long, c long"), "gathered")
    same = Window.partitionBy("kind", "key")
    first = F.row_number().over(same.orderBy("block")) == 1  # a group has a few rows for each block
    located = written(gathered.select("kind", "block", "key", F.sum("c").over(same).alias("c"), first.alias("first")), "located")
    n_words = gathered.where("kind = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    discarded(gathered)
    n_distinct = located.where("kind = 0 and first and c > 0").count()
    grams = located.where("kind = 1 and first").select("key", "c")
    ends = source.where(~F.col("held_out")).count()
    tokens, distinct = int(n_words) + ends, n_distinct + (ends > 0)
    pairs = pair_counts(grams)
    mixer = train_mixer(grams, pairs)
    logs = _dealt(grams).mapInArrow(_gram_scores(pairs, mixer), "key long, value float, low float")
    # a word's count as two numbers that single precision holds exactly
    part = lambda x: x.cast("float")
    words = located.where("kind = 0").select("block", "kind", "key", part(F.col("c") % COUNT_PART).alias("value"), part(F.floor(F.col("c") / COUNT_PART)).alias("low"))
    vocabulary = words.unionByName(located.where("kind = 1").select("block", "kind", "key").join(logs, "key"))
    run = _scored(tokens, distinct, ends)
    out = source.groupBy("block").cogroup(vocabulary.groupBy("block")).applyInArrow(run, _SCORES)
    size = -F.col("score") * float(np.log2(10))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", (size / F.col("n_bytes")).alias("bits_per_byte"))


def op7_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
