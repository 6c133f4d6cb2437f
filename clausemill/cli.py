"""Commands: ``python -m clausemill.cli ingest STORE PATH [--json]`` and ``report STORE``.

Exit codes: 0 done, 1 some file was rejected (or a document is not approvable), 2 no such path.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import preview


def ingest_lines(engine: Engine, path: str, *, as_json: bool = False) -> tuple[list[str], int]:
    """Lines to print about an ingestion, and the exit code."""
    hadoop = engine.spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(engine.spark._jsc.hadoopConfiguration()).exists(hadoop):
        return [f"error: no such file: {path}"], 2
    rejected = [(r.filename, r.reason) for r in engine.ingest(path).orderBy("filename").limit(1000).collect()]
    out = {**engine.status(), "store": engine.store.path, "rejected": [{"filename": f, "reason": r} for f, r in rejected]}
    if as_json:
        return [json.dumps(out, indent=2)], int(bool(rejected))
    lines = [f"{k:<16}{out[k]}" for k in ("documents", "retrieval", "store")]
    return lines + [f"error: {f}: {r}" for f, r in rejected], int(bool(rejected))


def report(obligations: DataFrame) -> DataFrame:
    """document_id, ordinal, line: a line of text for each obligation, and the reason below a failed one."""
    shown = F.when(F.coalesce("quote", F.lit("")) != "", preview(F.col("quote"))).otherwise(F.concat(F.coalesce("computation_formula", F.lit("")), F.lit(" (calculated in code)")))
    page = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("p."), F.col("page").cast("string"))).otherwise("—")
    cells = ((F.col("obligation_type"), 28), (F.coalesce("normalized_value", F.lit("None")), 22), (F.col("status"), 9), (page, 5))
    line = F.concat_ws(" ", *(F.rpad(F.substring(c, 1, n), n, " ") for c, n in cells), shown)
    why = F.when(F.col("status") == "failed", F.concat(F.lit("\n" + " " * 28 + " └─ "), F.coalesce("verification_reason", F.lit("")))).otherwise("")
    return obligations.select("document_id", "ordinal", F.concat(line, why).alias("line"))


def report_lines(engine: Engine) -> tuple[list[str], int]:
    """The report of all stored obligations, up to 10,000 lines; exit code 1 if any document cannot be approved."""
    lines: list[str] = []
    rows = report(engine.store.read("obligations")).orderBy("document_id", "ordinal").limit(10_000).collect()
    verdicts = {r.document_id: r.can_approve for r in engine.last_extraction().where(F.col("document_id").isin(sorted({r.document_id for r in rows}))).collect()}
    for k, r in enumerate(rows):
        if not k or rows[k - 1].document_id != r.document_id:
            lines += ["", f"{r.document_id}  can_approve = {verdicts.get(r.document_id, False)}"]
        lines.append(r.line)
    return lines, int(engine.last_extraction().where("not can_approve").count() > 0)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "report"):
        one = commands.add_parser(name)
        one.add_argument("store")
        if name == "ingest":
            one.add_argument("path")
            one.add_argument("--json", action="store_true")
    given = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), given.store)
    lines, code = ingest_lines(engine, given.path, as_json=given.json) if given.command == "ingest" else report_lines(engine)
    print("\n".join(lines), file=sys.stderr if code == 2 else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
