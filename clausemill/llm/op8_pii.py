"""Personal data: exact patterns, and a semi-Markov conditional random field for the rest.

The field scores whole candidate spans of up to MAX_TOKENS words by features of
the span (digits, separators, shape, checksum), and a dynamic program over bounded
spans picks boundaries and types together.  It is fitted here, by the gradient of
its exact log-likelihood, on examples generated by rule from a fixed seed.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 6
#: Words whose candidates' features are held at once.
PIECE = 512
#: Examples that the field is fitted on, passes over them, and the odds a span must have to be added.
EXAMPLES, EPOCHS, SURE = 900, 8, 0.9

_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile("[0-9.]+")
_CARD = re.compile("[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its check; linear in the text."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for run in _DOTTED.finditer(text):
        parts, offset, i = run[0].split("."), run.start(), 0
        if len(parts) < 4:
            continue
        starts = []
        for p in parts:
            starts.append(offset)
            offset += len(p) + 1
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(map(_byte, four)):
                    out.append(("ip", starts[i], starts[i + 3] + len(four[3])))
                i += 4
            else:
                i += 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_NAMES = (
    "bias", "at_one", "at_more", "dot_after_at", "letters_by_at", "letters", "digits_0", "digits_1", "digits_8", "digits_10", "digits_12", "digits_16", "digits_20", "plus_first", "brackets", "hyphens", "dots",
    "slash_colon", "other_sign", "quad", "quad_shape", "luhn_16", "one_word", "two_words", "three_words", "four_words", "groups_of_four", "phone_groups", "mostly_digits", "other_word",
)
_GROUPS = re.compile("[0-9]+")
_PHONE_SHAPE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){1,4}$")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")


def span_features(span: str, words: int) -> np.ndarray:
    digits = "".join(_GROUPS.findall(span))
    groups = [len(g) for g in _GROUPS.findall(span)]
    n, ats = len(digits), span.count("@")
    letters = any(c.isalpha() for c in span)
    local, _, domain = span.partition("@")
    parts = span.split(" ")
    f = {
        "bias": 1, "at_one": ats == 1, "at_more": ats > 1, "dot_after_at": ats == 1 and _DOMAIN.fullmatch(domain) is not None, "letters_by_at": ats == 1 and local != "" and all(c in _LOCAL for c in local), "letters": letters and not ats,
        "digits_0": n == 0, "digits_1": 1 <= n < 8, "digits_8": 8 <= n < 10, "digits_10": 10 <= n < 12, "digits_12": 12 <= n < 16, "digits_16": 16 <= n < 20, "digits_20": n >= 20,
        "plus_first": span[:1] == "+", "brackets": "(" in span and ")" in span, "hyphens": "-" in span, "dots": "." in span, "slash_colon": any(c in "/:" for c in span), "other_sign": any(c in "$€£%#,;*=_&" for c in span),
        "quad": bool(_QUAD.match(span)) and all(map(_byte, span.split("."))), "quad_shape": bool(_QUAD.match(span)), "luhn_16": 16 <= n <= 19 and luhn(digits),
        "one_word": words == 1, "two_words": words == 2, "three_words": words == 3, "four_words": words >= 4, "groups_of_four": len(groups) >= 4 and all(g == 4 for g in groups[:-1]),
        "phone_groups": bool(_PHONE_SHAPE.match(span)) and len(groups) >= 3 and 10 <= n <= 15, "mostly_digits": n * 2 > len(span), "other_word": any(not _TRIGGER.search(p) for p in parts),
    }
    return np.array([float(f[k]) for k in _NAMES])


_OUTER = ".,;:!?\"'<>[]{}"


def _from(text: str, starts: Sequence[int], ends: Sequence[int], i: int) -> Iterator[tuple[int, int, int]]:
    """Candidates that begin with word i: last word, start and end, outer punctuation left out."""
    for j in range(i, min(len(starts), i + MAX_TOKENS)):
        if j > i and "\n" in text[ends[j - 1] : starts[j]]:
            return
        start, end = starts[i], ends[j]
        while start < end and text[start] in _OUTER:
            start += 1
        while end > start and text[end - 1] in _OUTER:
            end -= 1
        if end > start and _TRIGGER.search(text, start, end):
            yield j, start, end


def candidates(text: str, starts: Sequence[int], ends: Sequence[int], lo: int, hi: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """First and last word, start and end of the candidates that begin with words lo to hi; their features."""
    found = [(i, *c) for i in range(lo, hi) for c in _from(text, starts, ends, i)]
    return found, np.array([span_features(text[s:e], j - i + 1) for i, j, s, e in found]).reshape(len(found), len(_NAMES))


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """The candidates of a run of words, and sums and maxima over all their segmentations.

    What is kept is a few numbers for each word and each of its MAX_TOKENS
    candidates; features are worked on PIECE words at a time, so memory stays
    small for runs of any length.
    """

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int], weights: np.ndarray, known: tuple[list, np.ndarray] | None = None):
        """known: candidates() of these words, if they have been worked out."""
        n = self.n = len(starts)
        self.text, self.starts, self.ends, self.weights = text, starts, ends, weights
        #: of each candidate, by first word and length in words: log of the summed odds of its kinds
        self.total = array("d", [-math.inf]) * (n * MAX_TOKENS)
        self.fore = array("d", [0.0]) + array("d", [-math.inf]) * n
        best = array("d", [0.0]) + array("d", [-math.inf]) * n
        #: of each place the words and kind of the span that ends there on the best way; 0 words: none
        self.words, self.kind = bytearray(n + 1), bytearray(n + 1)
        for lo in range(0, n, n if known else PIECE):
            found, features = known or candidates(text, starts, ends, lo, min(n, lo + PIECE))
            score = features @ weights.T
            total, kind, top = (x.tolist() for x in (np.logaddexp.reduce(score, axis=1), score.argmax(axis=1), score.max(axis=1, initial=-math.inf)))
            at = 0
            for t in range(lo, n if known else min(n, lo + PIECE)):
                self.fore[t + 1] = _logadd(self.fore[t + 1], self.fore[t])
                if best[t] >= best[t + 1]:
                    best[t + 1], self.words[t + 1] = best[t], 0
                while at < len(found) and found[at][0] == t:
                    j = found[at][1]
                    self.total[t * MAX_TOKENS + j - t] = total[at]
                    self.fore[j + 1] = _logadd(self.fore[j + 1], self.fore[t] + total[at])
                    if best[t] + top[at] > best[j + 1]:
                        best[j + 1], self.words[j + 1], self.kind[j + 1] = best[t] + top[at], j - t + 1, kind[at]
                    at += 1
        self.log_z, self.best_score = self.fore[n], best[n]

    def backward(self) -> array:
        """log of the summed odds of all segmentations of the words from each place on."""
        back = array("d", [0.0]) * (self.n + 1)
        for t in range(self.n - 1, -1, -1):
            x = back[t + 1]
            for k in range(min(MAX_TOKENS, self.n - t)):
                if (y := self.total[t * MAX_TOKENS + k]) != -math.inf:
                    x = _logadd(x, back[t + k + 1] + y)
            back[t] = x
        return back

    def best(self) -> list[tuple[str, int, int, float]]:
        """The best segmentation's spans, left to right, with each one's probability over all segmentations.

        Of segmentations that score the same, one with a word outside any span
        comes first, then the span that begins first.
        """
        out, t, back = [], self.n, None
        while t > 0:
            if not self.words[t]:
                t -= 1
                continue
            back = back or self.backward()
            i = t - self.words[t]
            start, end = next((s, e) for j, s, e in _from(self.text, self.starts, self.ends, i) if j == t - 1)
            score = float(span_features(self.text[start:end], t - i) @ self.weights[self.kind[t]])
            out.append((KINDS[self.kind[t]], start, end, math.exp(score + self.fore[i] + back[t] - self.log_z)))
            t = i
        return out[::-1]


class Field:
    """weights: kinds x features; a word outside any span scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def sure(self, text: str, starts: Sequence[int], ends: Sequence[int]) -> list[tuple[str, int, int]]:
        """The best segmentation's spans whose probability is at least SURE."""
        return [(kind, s, e) for kind, s, e, p in Lattice(text, starts, ends, self.weights).best() if p >= SURE]


def examples(count: int = EXAMPLES, seed: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Short texts with their spans, generated by rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = digits(r.choice((15, 15, 15, 17, 18)))
        body += next(d for d in "0123456789" if luhn(body + d))
        return r.choice(("", "", " ", "-")).join(body[i : i + 4] for i in range(0, len(body), 4))

    def email() -> str:
        return r.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}+{word()}")) + "@" + r.choice((word(), f"{word()}-{word()}", f"mail{digits(1)}.{word()}")) + r.choice((".com", ".org", ".de", ".co.uk"))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"))

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    make = {"email": email, "ip": ip, "card": card, "phone": phone}

    def not_luhn() -> str:
        while True:
            if not luhn(x := digits(r.choice((16, 16, 18)))):
                return x

    plain = [
        lambda: str(r.randint(1, 99)), lambda: str(r.randint(1900, 2100)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
        lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(256, 999)}.{digits(1)}.{digits(2)}.{digits(3)}", lambda: f"{r.randint(1, 23)}:{digits(2)}",
        lambda: f"{r.randint(1, 9)},{digits(3)},{digits(3)}", lambda: digits(r.randint(5, 12)), not_luhn, lambda: "@" + word(), lambda: f"{word()}@{word()}", lambda: f"{word()}{digits(3)}", lambda: f"{digits(3)}-{digits(4)}",
        lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: " ".join(str(r.randint(1, 500)) for _ in range(r.randint(2, 8))), lambda: f"#{digits(6)}", lambda: f"{digits(2)}%",
    ]
    out = []
    for _ in range(count):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            text += " " + r.choice(("", f"{word()} ", f"{word()} {word()} "))
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                found = make[kind]()
                spans.append((kind, len(text), len(text) + len(found)))
                text += found
            else:
                text += r.choice(plain)()
            text += r.choice(("", ",", ".", ""))
        out.append((text + " " + word(), spans))
    return out


@functools.lru_cache(maxsize=1)
def fitted() -> Field:
    """Stochastic gradient ascent on the log-likelihood of examples(); always the same."""
    field = Field(np.zeros((len(KINDS), len(_NAMES))))
    field.weights[:, 0] = -2
    data = []
    for text, spans in examples():
        tokens = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
        known = candidates(text, starts, ends, 0, len(tokens))
        observed = np.array([[(k, s, e) in spans for k in KINDS] for _, _, s, e in known[0]], float)
        data.append((text, starts, ends, known, observed))
    squares = np.full_like(field.weights, 1e-4)
    for epoch in range(EPOCHS):
        random.Random(epoch).shuffle(data)
        for text, starts, ends, known, observed in data:
            found, features = known
            if not found:
                continue
            lattice = Lattice(text, starts, ends, field.weights, known)
            back = lattice.backward()
            outside = np.array([lattice.fore[i] + back[j + 1] for i, j, _, _ in found])
            p = np.exp(features @ field.weights.T + outside[:, None] - lattice.log_z)
            g = (observed - p).T @ features - 1e-4 * field.weights
            squares += g * g
            field.weights += 0.4 * g / np.sqrt(squares)
    return field


def _islands(text: str) -> Iterator[tuple[array, array]]:
    """Runs of words that hold a digit or an at sign, with a word before, after and between; starts and ends."""
    starts, ends = array("q"), array("q")
    last, gap = None, 0
    for m in _WORD.finditer(text):
        if _TRIGGER.search(text, m.start(), m.end()):
            for at in [last, m.span()] if last and not starts else [m.span()]:
                starts.append(at[0])
                ends.append(at[1])
            gap = 0
        elif starts:
            gap += 1
            if gap > 1:
                yield starts, ends
                starts, ends = array("q"), array("q")
            else:
                starts.append(m.start())
                ends.append(m.end())
        last = m.span()
    if starts:
        yield starts, ends


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The field's spans that touch no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for first, last in _islands(text):
        for kind, s, e in field.sure(text, first, last):
            i = bisect.bisect_left(starts, e) - 1
            if i < 0 or ends[i] <= s:
                out.append((kind, s, e))
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans and added ones of a text."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, field)


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def found_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans for every row of docs.

    spans lists base and added spans as kind:start:end (code points, end
    exclusive), by kind, then start.  Added spans touch no base span; of equally
    good segmentations the one of Lattice.best() is taken.  A text of any length is
    read whole, with a few numbers held for each word of a run with digits.  A null
    or empty text has no spans; the digest is then that of the empty string.
    Repeated rows get equal results; a null id stays null; other columns are
    ignored; an empty table gives an empty result.
    """

    field = fitted()  # on the driver; its weights, 120 numbers, go with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                base, added = all_spans(text, field)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(base + added))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def without_pii(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans of each text replaced by [EMAIL], [IP], [CARD] or [PHONE]; chars_col, if there, counts anew."""

    field = fitted()  # on the driver; its weights, 120 numbers, go with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            changed = False
            for i, text in enumerate(texts):
                base, added = all_spans(text, field)
                if base or added:
                    texts[i], changed = masked_text(text, base + added), True
            if changed:
                at = batch.schema.get_field_index(text_col)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out


def op8_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
