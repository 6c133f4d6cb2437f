"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Native throughout: counts, votes, the EM loop and the posterior are SQL
expressions.  The EM works on the table of vote patterns, at most 3^7 rows
whatever the input, folded inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: name -> (vote good when, vote bad when); neither: abstain.  On the counts of _counts().
RULES = {
    "length": ("n_words between 40 and 1000000", "n_words < 15"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "symbols": ("n_symbols * 100 <= n_words", "n_symbols * 10 > n_words"),
    "repeated_lines": ("n_dup_lines * 20 <= n_lines", "n_dup_lines * 10 > n_lines * 3"),
    "repeated_words": ("n_repeat_words * 20 <= n_words", "n_repeat_words * 10 > n_words * 2"),
    "letters": ("n_letters * 100 >= word_chars * 80", "n_letters * 100 < word_chars * 60"),
    "closed_lines": ("n_closed * 10 >= n_lines * 6", "n_closed * 10 < n_lines"),
}
ROUNDS = 30
#: Where the EM starts: chances of a bad, an abstaining and a good vote on a good and on a bad
#: document, the share of good ones, and the weight of these as a share of all documents.
IF_GOOD, IF_BAD, SHARE, STRENGTH = (0.01, 0.09, 0.90), (0.30, 0.20, 0.50), 0.9, 0.02

_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
# positions covered by the 5-word windows whose hash occurs twice; h: the windows' 64-bit hashes in order
_COVERED = """
element_at(transform(array(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
  aggregate(
    array_sort(transform(filter(s, (e, j) -> (j > 0 and s[greatest(j - 1, 0)].x = e.x) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = e.x)), e -> e.i)),
    named_struct('n', 0, 'e', 0),
    (a, p) -> named_struct('n', a.n + p + 5 - greatest(a.e, p), 'e', p + 5),
    a -> a.n)), 1)
"""
_REPEATED = f"""
if(size(w) < 6, 0, element_at(transform(
  array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))),
  h -> if(size(array_distinct(h)) = size(h), 0, {_COVERED})), 1))
"""
_LINES = r"filter(split(t, '\n', -1), x -> translate(x, ' \t\u000b\u000c\r', '') <> '')"
_COUNTS = rf"""
element_at(transform(array(coalesce(TEXT, '')), t -> named_struct(
  'text', element_at(transform(array({_WORDS}), w -> named_struct('n_words', size(w), 'n_repeat_words', {_REPEATED})), 1),
  'word_chars', length(translate(t, ' \t\n\u000b\u000c\r', '')),
  'n_symbols', length(t) - length(translate(t, '#*$%&|<>', '')),
  'n_letters', length(regexp_replace(t, '\\P{{L}}+', '')),
  'lines', element_at(transform(array({_LINES}), l -> named_struct('n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)), 'n_closed', size(filter(l, x -> right(rtrim(' \t\u000b\u000c\r', x), 1) in ('.', '!', '?', ':', '"', '”', '»', ')'))))), 1))), 1)
"""


def _counts(text: str) -> Column:
    return F.expr(_COUNTS.replace("TEXT", f"`{text}`"))


def _judged(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs' columns keep and a struct _q: counts, vote code, base_failed.  Written once."""
    flat = docs.select("*", _counts(text).alias("_c")).select(
        *[F.col(f"`{c}`") for c in keep],
        F.struct(
            *(F.col(f"_c.{p}{n}").cast("long").alias(n) for p, n in (("text.", "n_words"), ("", "word_chars"), ("", "n_symbols"), ("lines.", "n_dup_lines"), ("text.", "n_repeat_words"), ("lines.", "n_lines"), ("lines.", "n_closed"), ("", "n_letters"))),
        ).alias("_q"),
    )
    base = F.expr("_q.n_words < 10 or 100 * _q.n_repeat_words > 20 * _q.n_words")
    code = F.lit(0)
    for j, (good, bad) in enumerate(RULES.values()):
        vote = F.when(_on(bad), 0).when(_on(good), 2).otherwise(1)
        code = code + vote * 3**j
    return written(flat.select(*[F.col(f"`{c}`") for c in keep], F.col("_q").withField("base_failed", base).withField("code", code.cast("int")).alias("_q")), "judged")


def _on(rule: str) -> Column:
    import re

    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"_q.\1", rule))


def _posteriors(codes: DataFrame) -> DataFrame:
    """(code, p_good, if_good, if_bad) for each vote pattern that occurs; EM from _q.code's counts."""
    k = len(RULES)
    votes = F.expr(f"transform(sequence(0, {k - 1}), j -> pmod(cast(code / pow(3, j) as int), 3))")
    one = codes.groupBy(F.col("_q.code").alias("code")).agg(F.count("*").cast("double").alias("c"))
    one = one.select("code", "c", votes.alias("v")).agg(F.sort_array(F.collect_list(F.struct("code", "c", "v"))).alias("pats"), F.sum("c").alias("n"))
    array = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    odds = f"ln(s.share / (1 - s.share)) + aggregate(sequence(0, {k - 1}), 0D, (x, j) -> x + ln(s.if_good[j][p.v[j]] / s.if_bad[j][p.v[j]]))"
    q = f"1 / (1 + exp(-({odds})))"
    chances = lambda q, start: f"""transform(sequence(0, {k - 1}), j -> transform(sequence(0, 2), x ->
        (aggregate(ps, 0D, (a, p) -> a + if(p.v[j] = x, p.c * {q}, 0D)) + {STRENGTH}D * n * {array(start)}[x])
        / (aggregate(ps, 0D, (a, p) -> a + p.c * {q}) + {STRENGTH}D * n)))"""  # noqa: E731
    step = f"""
    element_at(transform(array(transform(pats, p -> named_struct('v', p.v, 'c', p.c, 'q', {q}))), ps -> named_struct(
      'share', least(greatest((aggregate(ps, 0D, (a, p) -> a + p.c * p.q) + {STRENGTH * SHARE}D * n) / (n * {1 + STRENGTH}D), 0.05D), 0.99D),
      'if_good', {chances("p.q", IF_GOOD)},
      'if_bad', {chances("(1 - p.q)", IF_BAD)})), 1)
    """
    start = f"named_struct('share', {SHARE}D, 'if_good', array_repeat({array(IF_GOOD)}, {k}), 'if_bad', array_repeat({array(IF_BAD)}, {k}))"
    fitted = one.where("size(pats) > 0").select("pats", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step})").alias("s"))
    return fitted.select("s", F.explode("pats").alias("p")).select(F.col("p.code").alias("code"), F.expr(q).alias("p_good"), F.col("s.if_good").alias("if_good"), F.col("s.if_bad").alias("if_bad"))


def _verdicts(judged: DataFrame) -> DataFrame:
    post = written(_posteriors(judged), "posteriors")
    # at most 3^7 rows, one for each pattern of votes
    return judged.join(F.broadcast(post), F.col("_q.code") == post["code"], "left").withColumn("_kept", ~F.col("_q.base_failed") & (F.col("p_good") >= 0.5))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept for every row of docs.

    n_repeat_words counts the words in 5-word windows that occur twice or more
    (compared by 64-bit hashes of the five words).  kept is false if base_failed,
    else whether the posterior probability of good quality is at least a half.
    A null text counts as empty; it and a text without words have all counts 0
    and base_failed.  Each row is judged alone, so repeated rows get the same
    verdict; a null id stays null.  Other columns are ignored; an empty table
    gives an empty result.
    """
    judged = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"])
    out = _verdicts(judged)
    return out.select("doc_id", *(F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "p_good", F.col("_kept").alias("kept"))


def only_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that quality() keeps."""
    return _verdicts(_judged(docs, text_col, docs.columns)).where("_kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
