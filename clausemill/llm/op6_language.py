"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit has a logistic classifier on hashed
n-gram frequencies of the lower-cased text.  Decoding adds up the bits' logistic
losses, weighted by how well each bit did on the training texts, for every
codeword; the least total wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import discarded, written

#: The bound of the fit: texts for each language; in all, about; and for each language at least,
#: however many languages there are.  Every language that has a labelled text is learned.
PER_LANGUAGE, MOST_TEXTS, LEAST_TEXTS = 400, 4000, 10
DIMENSIONS = 1 << 12
FOLDS = 5
AMBIGUOUS = 0.2
_EPOCHS, _SCALE = 300, 300.0
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 18


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves fold by folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: all splits for up to five languages, else fixed pseudo-random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = (1 << (n - 1)) - 1
        return np.array([[1] * bits, *([1 if b >> (n - 2 - i) & 1 else -1 for b in range(bits)] for i in range(n - 1))])
    bits = int(np.ceil(10 * np.log2(n)))
    words = K.constants(n * bits, 0xEC0C).reshape(n, bits)
    return np.where((words >> np.uint64(40)) & np.uint64(1), 1, -1)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 2-gram and of the 3-gram that start at each byte but the last two."""
    x = K._LOWER[data].astype(np.uint32)
    two = x[:-2] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x85EBCA6B)
    three = two * np.uint32(0x9E3779B1) ^ x[2:] * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    return ((two * np.uint32(0x27D4EB2F)) >> shift).astype(np.int32), ((three * np.uint32(0x165667B1)) >> shift).astype(np.int32)


def _profile(text: str) -> np.ndarray:
    """Frequencies of a text's hashed n-grams; sums to one."""
    data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
    two, three = _grams(data)
    counts = np.bincount(two, minlength=DIMENSIONS) + np.bincount(three, minlength=DIMENSIONS)
    return (counts / max(1, counts.sum())).astype(np.float32)


class Model:
    """Languages, codewords, bit weights and the bits' weights in decoding."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Texts x languages; from the losses of all bits under each codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    def margins(self, column: pa.Array) -> np.ndarray:
        """Texts x bits; the mean weight of each whole text's n-grams."""
        data, offsets = K.flat(column)
        n = len(offsets) - 1
        padded = np.full(len(data) + 2 * n, 32, np.uint8)
        starts = offsets[:-1] + 2 * np.arange(n)
        shift = np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
        padded[np.arange(len(data)) + shift] = data
        ends = np.append(starts[1:], len(padded))
        out = np.zeros((n, len(self.bias)))
        for lo in range(0, max(0, len(padded) - 2), _CHUNK):  # a chunk may end inside a text; its sums add up
            hi = min(lo + _CHUNK, len(padded) - 2)
            two, three = _grams(padded[lo : hi + 2])
            value = self.weights[two] + self.weights[three]
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
            # positions of a text: starts .. ends - 3 (its last full 3-gram); the two that cross texts count for none
            a, b = np.clip(starts[first:last], lo, hi) - lo, np.clip(ends[first:last] - 2, lo, hi) - lo
            value = np.concatenate([value, np.zeros((1, value.shape[1]), value.dtype)])
            cuts = np.stack([a, np.maximum(b, a)], 1).reshape(-1)
            sums = np.add.reduceat(value, np.minimum(cuts, len(value) - 1), axis=0, dtype=np.float64)[::2]
            sums[b <= a] = 0
            out[first:last] += sums
        grams = 2 * np.maximum(ends - starts - 2, 1)
        return out / grams[:, None] * _SCALE + self.bias


def fit(profiles: np.ndarray, languages: list[str]) -> Model:
    """Full-batch Adam on the bounded sample; the same sample gives the same model."""
    names = sorted(set(languages))
    code = codewords(len(names)).astype(np.float32)
    place = {v: i for i, v in enumerate(names)}
    which = np.array([place[v] for v in languages])
    x, y = profiles * np.float32(_SCALE), code[which]
    weight = (1.0 / np.bincount(which))[which].astype(np.float32)
    weight /= weight.sum()
    w, bias = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moment, square = np.zeros_like(w), np.full_like(w, 1e-8)
    for t in range(1, _EPOCHS + 1):
        margin = np.clip(x @ w + bias, -30, 30)
        slope = -y / (1 + np.exp(y * margin)) * weight[:, None]
        g = x.T @ slope + np.float32(1e-6) * w
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= np.float32(0.02) * (moment / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        bias -= np.float32(0.1) * slope.sum(axis=0)
    right = (np.sign(x @ w + bias) == y).T @ weight
    return Model(names, code, w, bias, np.clip(2 * right - 1, 0.05, 1))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([_profile(text).astype("<f4").tobytes()])], ["lang", "profile"])


def training_sample(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Profiles of texts of every language, those of least hash of id: per_language for each, or
    fewer (LEAST_TEXTS at least) where there would be more than MOST_TEXTS; for docs (doc_id, text, lang), all not null."""
    languages = docs.select("lang").distinct().count()
    if not languages:
        return np.zeros((0, DIMENSIONS), np.float32), []
    most = min(per_language, max(LEAST_TEXTS, MOST_TEXTS // languages))
    order = F.xxhash64(F.col("doc_id"))
    ranked = docs.select("lang", order.alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    edges = written(ranked.where(F.col("k") <= most).groupBy("lang").agg(F.max("h").alias("edge")), "edges")  # a row for each language
    # repeated ids share a hash and may pass the edge together: the bound holds again here
    near = docs.join(edges, "lang").where(order <= F.col("edge")).select("lang", "doc_id", "text")
    got = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))).where(F.col("k") <= most)
    rows = got.select("lang", "text").mapInArrow(_profiles, "lang string, profile binary").orderBy("lang", "profile").collect()
    discarded(edges)
    return np.stack([np.frombuffer(r[1], "<f4") for r in rows]), [r[0] for r in rows]


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            column = batch.column("text")
            letter = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()])
            if model is None or not model.languages:
                best, score, unsure = np.full(len(letter), "und", object), np.zeros(len(letter)), np.ones(len(letter), bool)
            else:
                p = model.probabilities(model.margins(column))
                at = p.argmax(axis=1)
                best = np.array(model.languages, object)[at]
                score = p[np.arange(len(p)), at]
                rest = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                unsure = score - rest < AMBIGUOUS
            best = np.where(letter, best, "und")
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(best, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(unsure | ~letter)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs.

    Learns from texts of the rows that are not held out and whose language is
    given; the fit takes at most per_language of each language.  A prediction
    reads the whole text and nothing else.  A null text, or one without a letter,
    gives 'und' with score 0; so does every text if there is nothing to learn
    from.  A null id counts as not held out and teaches nothing.  Repeated rows
    get equal results; ties of two languages go to the name that sorts first.
    Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    teach = source.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    profiles, languages = training_sample(teach, per_language=per_language)
    out = predicted(source, fit(profiles, languages) if languages else None)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
