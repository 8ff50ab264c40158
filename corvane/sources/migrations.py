"""Numbered SQL migrations, each applied once, and their statements."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import SparkSession

from corvane.operators.state import Snapshot

SCHEMA = "version int, filename string, checksum string"


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def statements(sql: str) -> list[str]:
    """Statements between semicolons; comments go, and neither they nor quoted text nor $$ bodies split anything."""
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(\$\w*\$).*?\1|;|[^-/'\"$;]+|.", re.S)
    out, now = [], []
    for m in token.finditer(sql):
        x = m.group(0)
        if x.startswith(("--", "/*")) and len(x) > 1:
            now.append(" ")
        elif x == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(x)
    out.append("".join(now).strip())
    return [x for x in out if x]


def files(folder: str, suffix: str = ".sql") -> list[tuple[int, Path]]:
    found = [(int(m[1]), p) for p in Path(folder).iterdir() if p.name.endswith(suffix) and (m := re.match(r"(\d+)", p.name))]
    return sorted(found)


def latest(folder: str, suffix: str = ".sql") -> int:
    return max((n for n, _ in files(folder, suffix)), default=0)


def current(ledger: Snapshot) -> int:
    return ledger.read().selectExpr("coalesce(max(version), 0) AS v").first().v


def migrate(spark: SparkSession, folder: str, ledger: Snapshot, suffix: str = ".sql") -> list[int]:
    """Applies what is newer than the ledger, in order; stops at the first file that fails.

    A file is parsed as a whole before any of it runs, so one that is not SQL changes nothing. What a statement did that ran
    before another failed can't be undone in Spark; the file is not in the ledger then, and is run again.
    """
    done = []
    at = current(ledger)
    parser = spark._jsparkSession.sessionState().sqlParser()
    for number, path in files(folder, suffix):
        if number > at:
            text = path.read_text()
            for statement in statements(text):
                parser.parsePlan(statement)
            for statement in statements(text):
                spark.sql(statement)
            ledger.append(spark.createDataFrame([(number, path.name, checksum(text))], SCHEMA))
            done.append(number)
    return done
