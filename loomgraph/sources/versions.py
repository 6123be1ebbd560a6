"""Version-control sources: commands as argument lists, their output as tables of lines, and parsers of these lines.

The command runs on the driver with a time limit and without variables that may hold credentials; its output goes line by line
to a file in shared storage and is read from there, so it isn't held by the driver. Every value that comes from a caller is checked
before it becomes an argument.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.storage import shared_dir

REF = re.compile(r"^[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*(\.\.\.?[A-Za-z0-9_./~^@{}-]+)?$")
SYMBOL = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
RANGE = re.compile(r"^[A-Za-z0-9 :,.\-/+]{1,64}$")
# Names of environment variables that may hold credentials.
SECRETS = re.compile(r"(?i)secret|token|password|passphrase|credential|api[_-]?key|private[_-]?key|ssh[_-]?key|_dsn$|(database|redis|mongodb?|postgres|amqp|mysql)[_-]?(url|uri)$")
COMMIT = r"^([0-9a-f]{40})\s+(\S+)\s+(.+)$"


def valid_ref(ref: str) -> str:
    """a version-control reference or range that can't be read as an option."""
    if not REF.match(ref) or ref.startswith("-") or len(ref) > 200:
        raise ValueError(f"not a reference: {ref!r}")
    return ref


def valid_symbol(name: str) -> str:
    if not SYMBOL.match(name):
        raise ValueError(f"not a symbol: {name!r}")
    return name


def valid_path(path: str) -> str:
    """a path inside the project, or a path pattern, that can't be read as an option or as another place."""
    if not path or path.startswith(("-", "/", ":")) or ".." in path.split("/") or re.search(r"[\x00-\x1f]", path) or len(path) > 500:
        raise ValueError(f"not a path: {path!r}")
    return path


def since(text: str) -> tuple[str, int | str]:
    """F8: ("days", n) for "last n days|weeks|months", ("ref", r) for "since r", else ("since", text)."""
    if m := re.fullmatch(r"\s*last\s+(\d+)\s+(day|week|month)s?\s*", text, re.I):
        return "days", int(m[1]) * {"day": 1, "week": 7, "month": 30}[m[2].lower()]
    if m := re.fullmatch(r"\s*since\s+(\S+)\s*", text, re.I):
        return "ref", valid_ref(m[1])
    if not RANGE.match(text) or text.startswith("-"):
        raise ValueError(f"not a time range: {text!r}")
    return "since", text


def time_args(time_range: str | None) -> list[str]:
    if not time_range:
        return []
    kind, value = since(time_range)
    return {"days": [f"--since={value} days ago"], "ref": [f"{value}..HEAD"], "since": [f"--since={value}"]}[kind]


def path_args(path: str | None, excluded: list[str] | None = None) -> list[str]:
    """one path, or all but the excluded ones."""
    if path:
        return ["--", valid_path(path)]
    return ["--", ".", *(f":!{valid_path(p)}" for p in excluded)] if excluded else []


def name_only_args(time_range: str | None = None, path: str | None = None, excluded: list[str] | None = N.EXCLUDED) -> list[str]:
    """S7"""
    return ["log", "--format=%H", "--name-only", "--no-merges", *time_args(time_range), *path_args(path, excluded)]


def diff_args(commits: str, path: str | None = None, numstat: bool = False) -> list[str]:
    """The changes of a range of commits."""
    return ["diff", *(["--numstat"] if numstat else []), valid_ref(commits), *path_args(path)]


def history_args(file: str, symbol: str | None = None, lines: tuple[int, int] | None = None, time_range: str | None = None) -> list[str]:
    """The history of a symbol, of a range of lines, or of a whole file."""
    valid_path(file)
    if ":" in file:
        raise ValueError(f"not a path: {file!r}")
    place = [f"-L:{valid_symbol(symbol)}:{file}"] if symbol else [f"-L{int(lines[0])},{int(lines[1])}:{file}"] if lines else []
    return ["log", *place, "--format=%H %ad %an%n%s", "--date=short", "--no-merges", *time_args(time_range), *([] if place else ["--", file])]


def safe_env(env: dict[str, str] | None = None) -> dict[str, str]:
    """SC3: an environment without variables whose names speak of credentials."""
    return {k: v for k, v in (os.environ if env is None else env).items() if not SECRETS.search(k)}


def run(spark: SparkSession, root: str, args: list[str], program: str = "git", timeout: float = 30, log: str = "log") -> DataFrame:
    """log, k, text: the lines of a command's output. Raises ValueError if it fails or takes too long."""
    with tempfile.TemporaryDirectory() as folder:  # only the driver reads this copy
        made = os.path.join(folder, "lines")
        with open(made, "wb") as out, subprocess.Popen([program, *args], cwd=root, env=safe_env(), stdout=out, stderr=subprocess.PIPE) as child:
            try:
                _, errors = child.communicate(timeout=timeout)
            except subprocess.TimeoutExpired:
                child.kill()
                raise ValueError(f"{program} took longer than {timeout} s; narrow the range") from None
        if child.returncode:
            raise ValueError(f"{program}: {errors.decode('utf-8', 'replace').strip()[:500]}")
        numbered = os.path.join(folder, "numbered")
        with open(made, encoding="utf-8", errors="replace", newline="\n") as lines, open(numbered, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(f"{k}\t{line.rstrip(chr(10))}\n" for k, line in enumerate(lines))
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}.txt")
        there.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{numbered}"), there)
    rows = spark.read.option("lineSep", "\n").text(there.toString())
    return rows.select(F.lit(log).alias("log"), F.substring_index("value", "\t", 1).cast("long").alias("k"), F.expr("substring(value, instr(value, '\t') + 1)").alias("text"))


def commits(lines: DataFrame) -> DataFrame:
    """Log, place, sha, day, author, subject, added, removed of each commit of a log (log, k, text), in its order.

    A line of hash, day and author begins a commit; the first line after it that isn't blank is its subject; of the lines after that, those of a diff are counted.
    """
    begins = F.col("text").rlike(COMMIT)
    ordered = W.partitionBy("log").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("place", F.count(F.when(begins, 1)).over(ordered)).where("place > 0")
    rows = rows.withColumns({"head": begins, "blank": ~begins & ~F.col("text").rlike(r"\S")})
    subject = F.min(F.when(~F.col("head") & ~F.col("blank"), F.col("k"))).over(W.partitionBy("log", "place"))
    rows = rows.withColumn("subject_at", subject)
    after = F.col("k") > F.col("subject_at")
    sign = lambda c: F.count_if(after & F.col("text").startswith(c) & ~F.col("text").startswith(c * 3))
    head = F.max(F.when(F.col("head"), F.col("text")))
    out = rows.groupBy("log", "place").agg(head.alias("h"), F.max(F.when(F.col("k") == F.col("subject_at"), F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("subject"), sign("+").alias("added"), sign("-").alias("removed"))
    part = lambda n: F.regexp_extract("h", COMMIT, n)
    return out.select("log", "place", part(1).alias("sha"), part(2).alias("day"), F.regexp_replace(part(3), r"^\s+|\s+$", "").alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), "added", "removed")


def first_that_has_rows(*tables: DataFrame) -> DataFrame:
    """U4: the rows of the first table that has any; all have the same columns."""
    for table in tables[:-1]:
        if not table.isEmpty():
            return table
    return tables[-1]


def symbol_history(spark: SparkSession, root: str, file: str, symbol: str, lines: tuple[int, int] | None = None, time_range: str | None = None, timeout: float = 30) -> DataFrame:
    """Commits of a symbol: by its name, else by its lines, else of its file (level 0, 1, 2)."""
    tries = [history_args(file, symbol, None, time_range) if SYMBOL.match(symbol) else None, history_args(file, None, lines, time_range) if lines else None, history_args(file, None, None, time_range)]
    for level, args in enumerate(tries):
        try:
            found = commits(run(spark, root, args, timeout=timeout)) if args else None
        except ValueError:
            if level == 2:
                raise
            found = None
        if found is not None and (level == 2 or not found.isEmpty()):
            return found.withColumn("level", F.lit(level))
