"""Chat formatting: schema fingerprints choose a declarative mapping to canonical turns.

Native throughout.  A layout lists the nested field paths it is made of; the hash
of the paths a row has filled selects its mapping.  The template is

    <|turn|>ROLE<|text|>TEXT<|end|>    for each turn

and control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that a text must not bring into the output as they are: the template's own and other templates'.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"

#: name -> mapping, the most specific first: an (array path, role field, text field), or a list of
#: turns, each a (literal role, path, further path to append).  Paths under "may" can be null in a
#: row: that turn's text is then empty.
LAYOUTS = {
    "turns": {"array": ("turns", "role", "text"), "roles_as_they_are": True},
    "messages": {"array": ("messages", "role", "content")},
    "conversations": {"array": ("conversations", "from", "value")},
    "system_instruction_input": {"turns": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")], "may": ("output",)},
    "system_instruction": {"turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")], "may": ("output",)},
    "instruction_input": {"turns": [("user", "instruction", "input"), ("assistant", "output")], "may": ("output",)},
    "instruction": {"turns": [("user", "instruction"), ("assistant", "output")], "may": ("output",)},
    "system_prompt_completion": {"turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")], "may": ("completion",)},
    "prompt_completion": {"turns": [("user", "prompt"), ("assistant", "completion")], "may": ("completion",)},
    "system_prompt_response": {"turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")], "may": ("response",)},
    "prompt_response": {"turns": [("user", "prompt"), ("assistant", "response")], "may": ("response",)},
    "question_answer": {"turns": [("user", "question"), ("assistant", "answer")], "may": ("answer",)},
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields, nested ones too; sorted."""
    out = []
    for f in schema:
        out.append(prefix + f.name)
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += field_paths(kind, f"{prefix}{f.name}.")
    return sorted(out)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout_paths(layout: dict) -> list[str]:
    if "array" in layout:
        top, role, text = layout["array"]
        return sorted([top, f"{top}.{role}", f"{top}.{text}"])
    return sorted({p for turn in layout["turns"] for p in turn[1:]})


def row_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the paths that a row has filled under the given columns, the nested ones of a filled column included."""
    filled = []
    for f in df.schema:
        if f.name in columns:
            below = field_paths(T.StructType([f]))
            filled.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*map(F.lit, below))))
    if not filled:
        return F.sha2(F.lit(""), 256)
    return F.sha2(F.array_join(F.array_sort(F.flatten(F.filter(F.array(*filled), lambda x: x.isNotNull()))), "\n"), 256)


def layout_fingerprints(df: DataFrame, layout: dict) -> list[str]:
    """Fingerprints of the rows that fit a layout: with each choice of the paths that may be null."""
    paths, may = layout_paths(layout), layout.get("may", ())
    return [fingerprint(_present(df, [p for p in paths if p not in out])) for k in range(len(may) + 1) for out in itertools.combinations(may, k)]


def _role(role: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = F.coalesce(role, F.lit(""))
    for known, canonical in ROLES.items():
        out = F.when(low == known, F.lit(canonical)).otherwise(out)
    return out


def _turn(named: Callable[[Column], Column], role: str, text: str) -> Callable[[Column], Column]:
    return lambda t: F.struct(named(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, *, keys: list[str], layouts: dict | None = None) -> DataFrame:
    """keys, layout and turns (array of role, text) of each row.

    Columns other than keys make up the layout.  Of the layouts whose columns the
    table has, a row gets the first in order (the most specific) whose fingerprint
    its filled columns of that layout have; columns that the chosen layout does not
    name, filled or not, do not count, so one table may mix layouts.  A row that
    fits none has layout null and no turns.  Null texts count as empty; repeated
    rows get equal results; an empty table gives an empty result.
    """
    layouts = layouts or LAYOUTS
    paths = set(field_paths(df.schema)) - set(keys)
    usable = {k: v for k, v in layouts.items() if set(layout_paths(v)) <= paths}
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for k, layout in reversed(usable.items()):
        columns = [p.split(".")[0] for p in layout_paths(layout)]
        here = row_fingerprint(df, columns).isin(layout_fingerprints(df, layout))
        if "array" in layout:
            top, role, text = layout["array"]
            named = (lambda r: F.coalesce(r, F.lit(""))) if layout.get("roles_as_they_are") else _role
            made = F.transform(F.col(f"`{top}`"), _turn(named, role, text))
        else:
            made = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.nullif(F.col(f"`{p}`"), F.lit("")) for p in of)).alias("text")) for role, *of in layout["turns"]))
        name = F.when(here, F.lit(k)).otherwise(name)
        turns = F.when(here, made).otherwise(turns)
    return df.select(*(F.col(f"`{k}`") for k in keys), name.alias("layout"), F.coalesce(turns, F.array().cast(_TURNS)).alias("turns"))


def _present(df: DataFrame, paths: list[str]) -> list[str]:
    """The layout's paths, and further fields nested below its top columns in df."""
    tops = {p.split(".")[0] for p in paths}
    return [p for p in field_paths(df.schema) if p.split(".")[0] in tops]


def escaped(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _starts(lengths: Column, width: int = 64) -> Column:
    """Prefix sums of an array (exclusive): in chunks, so that long arrays stay cheap."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    chunk = lambda x, c: F.slice(x, c * width + 1, F.lit(width))
    chunks = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  value is computed once
    inner = lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i)))
    per_chunk = lambda x: bind(F.transform(chunks(x), lambda c: total(chunk(x, c))), lambda sums: F.flatten(F.transform(chunks(x), lambda c: bind(chunk(x, c), lambda part: inner(part, total(F.slice(sums, F.lit(1), c)))))))
    return bind(lengths, per_chunk)


def formatted_chats(turns: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, formatted, loss_turns (booleans by turn) and loss_spans (start, end in code points of formatted).

    The loss mask holds the text of each turn whose role is assistant; its marks
    and other turns are outside.  No turns give an empty string and no spans.
    """
    piece = F.transform("turns", lambda t: F.struct(t.role.alias("raw"), F.concat(F.lit(TURN), escaped(t.role), F.lit(TEXT)).alias("head"), escaped(t.text).alias("body")))
    made = turns.select(*(F.col(f"`{k}`") for k in keys), piece.alias("pieces"))
    size = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]).cast("long") + len(END))
    spans = F.transform(F.arrays_zip(_starts(size).alias("s"), F.col("pieces").alias("p")), lambda z: F.struct(z["p"]["raw"].alias("raw"), (z["s"] + F.length(z["p"]["head"])).alias("start"), (z["s"] + F.length(z["p"]["head"]) + F.length(z["p"]["body"])).alias("end")))
    return made.select(
        *(F.col(f"`{k}`") for k in keys),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform("pieces", lambda p: p["raw"] == LOSS_ROLE).alias("loss_turns"),
        F.transform(F.filter(spans, lambda s: s["raw"] == LOSS_ROLE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
    )


def parsed_chats(formatted: Column) -> Column:
    """The turns that a formatted string was made from."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text")),
    )


def chat_digests(formatted: DataFrame, *, keys: list[str]) -> DataFrame:
    """What can be read back from formatted_chats()'s output."""
    read = formatted.select(*(F.col(f"`{k}`") for k in keys), "formatted", "loss_turns", parsed_chats(F.col("formatted")).alias("read"))
    under = F.transform(F.filter(F.arrays_zip(F.col("read").alias("t"), F.col("loss_turns").alias("m")), lambda z: z["m"]), lambda z: z["t"]["text"])
    read = read.withColumn("loss", F.array_join(under, ""))
    return read.select(
        *(F.col(f"`{k}`") for k in keys),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def turn_rows(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Conversations kept a row for each turn: key and an array turns (role, text), by turn.

    Ties of turn go by role, then text; a null turn comes first; a null role or
    text counts as empty; repeated rows are turns of their own; rows with a null
    key form one conversation.  A conversation is one value of the result, so its
    texts must fit a row.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = rows.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return kept.select(key, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) as t(conv_id, turn, role, text)")
    turns = canonical_turns(turn_rows(rows.unionByName(extra)), keys=["conv_id"])
    return chat_digests(formatted_chats(turns, keys=["conv_id"]), keys=["conv_id"])


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(TURN) + len(TEXT) + len(END)}) as bigint) as formatted_chars
from rows group by conv_id
"""
