"""Spans, diffs and history: interval and nearest joins, churn, co-change, impact, evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.sources.versions import since
from loomgraph.storage import numbered, written


def blocks(spans: DataFrame) -> DataFrame:
    """file, level, block, best: the innermost span (later ones win ties) of each block of 2^level lines that a span is made of.

    Spans are cut as in a segment tree, into at most two blocks a level; of the spans of a block one is left, so however many lie over a line, it meets one a level.
    """
    cuts = """flatten(transform(transform(sequence(0, length(bin(`end` - start + 1)) - 1), k -> struct(k, shiftright(start + shiftleft(1L, k) - 1, k) AS a, shiftright(`end` + 1, k) AS b)),
        x -> filter(array(if(x.a < x.b AND x.a % 2 <> 0, struct(x.k AS level, x.a AS block), NULL), if(x.a < x.b AND x.b % 2 <> 0, struct(x.k AS level, x.b - 1 AS block), NULL)), y -> y IS NOT NULL)))"""
    whole = spans.where("start <= `end`").groupBy("file", *[F.col(c).cast("long").alias(c) for c in ("start", "end")]).agg(F.max(F.struct("ord", "id")).alias("last"))
    cut_up = whole.select("file", F.struct((F.col("start") - F.col("end")).alias("tight"), "last.ord", "last.id").alias("best"), F.explode(F.expr(cuts)).alias("cut"))
    return cut_up.groupBy("file", "cut.level", "cut.block").agg(F.max("best").alias("best"))


def innermost(places: DataFrame, spans: DataFrame) -> DataFrame:
    """file, line, id of each distinct place (file, line) that a span (file, start, end, id, ord) holds: the innermost, later ones win ties."""
    found = written(blocks(spans))
    top = F.broadcast(found.agg(F.max("level").alias("top")))  # one row
    at = places.select("file", "line").distinct().join(top).select("file", "line", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    at = at.withColumn("block", F.expr("shiftright(CAST(line AS BIGINT), level)"))
    best = at.join(found, ["file", "level", "block"]).groupBy("file", "line").agg(F.max("best").alias("best"))
    return written(best.select("file", "line", "best.id"))


def with_id(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct rows of lines whose place is in found (file, line, id), with its id."""
    return lines.join(found, ["file", "line"]).select(*lines.columns, "id").distinct()


def attribute(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span (file, start, end, id, ord) that holds each distinct row of lines (file, line, ...); later spans win ties."""
    return with_id(lines, innermost(lines, spans))


def nearest_span(lines: DataFrame, starts: DataFrame, reach: int = 9) -> DataFrame:
    """For each line the span whose first line is nearest within reach, the one above first. Distinct places meet the first span of each start."""
    first = starts.groupBy("file", F.col("start").cast("long").alias("at")).agg(F.min(F.struct("ord", "id")).alias("first"))
    line = F.col("line").cast("long")
    around = lines.select("file", "line").distinct().withColumn("at", F.explode(F.sequence(line - reach, line + reach)))
    best = F.min(F.struct(F.abs(line - F.col("at")).alias("gap"), (F.col("at") > line).alias("below"), "first")).alias("best")
    found = around.join(first, ["file", "at"]).groupBy("file", "line").agg(best)
    return with_id(lines, written(found.select("file", "line", "best.first.id")))


def fill_forward(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row's value, or the last one before it, within a key."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def new_lines(rows: DataFrame, key: str, order: str, start: str, sign: str) -> DataFrame:
    """The new-side line of each diff line: added and context lines advance it, removed ones are at the present line."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("line", (F.col(start) + F.coalesce(F.sum(F.when(F.col(sign) != "-", 1).otherwise(0)).over(w), F.lit(0))).cast("long"))


def parse_diff(lines: DataFrame) -> DataFrame:
    """Hunk lines of unified diffs. lines: diff, k (line number), text; one row each for lines within a hunk."""
    w = W.partitionBy("diff").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    file = F.when(F.col("text").rlike(r"^\+\+\+ b/"), F.regexp_replace("text", r"^\+\+\+ b/", "")).when(F.col("text").rlike("^(diff |--- )"), "")
    start = F.when(F.col("text").rlike(r"^@@ -\d+"), F.regexp_extract("text", r"\+(\d+)", 1).cast("int")).when(F.col("text").rlike(r"^(diff |--- |\+\+\+ )"), -1)
    rows = lines.withColumns({"file": F.last(file, True).over(w), "new_start": F.last(start, True).over(w), "hunk": F.count(F.when(F.col("text").rlike("^@@ "), 1)).over(w)})
    rows = rows.where(~F.col("text").rlike(r"^(@@ |diff |--- |\+\+\+ |index |\\)") & (F.col("new_start") >= 0) & (F.coalesce("file", F.lit("")) != ""))
    rows = rows.withColumns({"sign": F.when(F.col("text").startswith("+"), "+").when(F.col("text").startswith("-"), "-").otherwise(" "), "key": F.concat_ws("#", F.col("diff").cast("string"), F.col("hunk").cast("string"))})
    return new_lines(rows, "key", "k", "new_start", "sign").select("diff", "k", "file", "line", "sign")


def file_churn(changes: DataFrame, limit: int | None = 20) -> DataFrame:
    """A3: distinct commits (sha) of each file."""
    out = changes.groupBy("file").agg(F.countDistinct("sha").alias("commits"))
    return out.orderBy(F.desc("commits"), "file").limit(limit) if limit else out


def symbol_churn(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """A4: distinct commits, added and removed lines of each symbol. lines: sha, file, line, sign."""
    hit = lines.join(innermost(lines, spans), ["file", "line"])
    return hit.groupBy("id").agg(F.countDistinct("sha").alias("commits"), F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"))


def in_range(changes: DataFrame, time_range: str | None, today: str, after: str | None = None, day: str = "day") -> DataFrame:
    """F8: the changes of a time range, by their day. today: the day that "last n days" counts from; after: the day of the reference of "since"."""
    if not time_range:
        return changes
    kind, value = since(time_range)
    if kind == "days":
        return changes.where(F.to_date(day) >= F.date_sub(F.lit(today).cast("date"), int(value)))
    return changes.where(F.to_date(day) >= F.lit(after if kind == "ref" else value).cast("date"))


def in_paths(changes: DataFrame, path: str | None = None, excluded: list[str] = N.EXCLUDED) -> DataFrame:
    """the changes of a path (a folder, a file, or a pattern with * and ?), or all but the excluded ones (with a slash at the end: folders)."""
    file = F.col("file")
    if path:
        if any(c in path for c in "*?"):
            pattern = "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in path)
            return changes.where(file.rlike(f"^{pattern}$"))
        folder = path.rstrip("/")
        return changes.where((file == folder) | file.startswith(folder + "/"))
    return changes.where(~N.either([F.lit(False)] + [file.startswith(x) if x.endswith("/") else (file == x) | file.startswith(x + "/") for x in excluded]))


def symbol_churn_or_files(lines: DataFrame, spans: DataFrame, files: int | None = 50) -> DataFrame:
    """A4, U4: symbol_churn of the most changed files; where none of their lines is in a symbol, the code files themselves."""
    if files:
        lines = lines.join(file_churn(lines, files).select("file"), "file", "left_semi")
    found = symbol_churn(lines, spans)
    if not found.isEmpty():
        return found
    own = lines.where(N.is_code(F.col("file"))).groupBy("file").agg(F.countDistinct("sha").alias("commits"), F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"))
    return own.select(F.concat(F.lit("FILE:"), "file").alias("id"), "commits", "added", "removed")


def co_change(changes: DataFrame, item: str, least: int = 2, most_in_commit: int | None = None, cell: int = 1000) -> DataFrame:
    """Pairs changed in the same commit at least `least` times.

    All commits count unless most_in_commit is given. Pairs grow with the square of a commit's items, so a commit of more than
    `cell` items is dealt into hash blocks of about that many, and each two blocks meet under a key of their own.
    """
    own = changes.select("sha", item).distinct()
    sizes = own.groupBy("sha").agg(F.count("*").alias("n")).where("n >= 2")
    sizes = sizes.where(F.col("n") <= most_in_commit) if most_in_commit else sizes
    blocks = F.ceil(F.col("n") / cell).cast("int")
    own = own.join(sizes, "sha").select("sha", F.col(item).alias("item"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    own = own.select("sha", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "item", "block")
    a, b = (own.select("sha", "x", "y", F.col("item").alias(side), F.col("block").alias("block_" + side)) for side in "ab")
    met = a.join(b, ["sha", "x", "y"]).where("a < b AND (x = y OR block_a <> block_b)")
    return met.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def impact(lines: DataFrame, spans: DataFrame, limit: int = 50) -> DataFrame:
    """Symbols touched by a set of changes, most changed lines first."""
    hit = symbol_churn(lines, spans).withColumn("changed", F.col("added") + F.col("removed"))
    return hit.orderBy(F.desc("changed"), "id").limit(limit)


def impact_totals(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Files, symbols and commits of a set of changes, one row."""
    symbols = attribute(lines.select("file", "line").distinct(), spans).agg(F.countDistinct("id").alias("symbols"))
    return lines.agg(F.countDistinct("file").alias("files"), F.countDistinct("sha").alias("commits")).join(symbols)  # one row each


def pick(matches: DataFrame, crate: str | None = None) -> DataFrame:
    """Place, id of the matches of a name, the one to follow first: of the crate if any is, then by callers, then not a test, then in the order of the graph."""
    rows = matches.withColumn("outside", ~F.contains(F.lower("id"), F.lit(crate.lower())) if crate else F.lit(False))
    best = rows.agg(F.min("outside").alias("least"))
    rows = rows.join(F.broadcast(best)).where("outside = least")  # one row
    return numbered(rows.select("id", "in_degree", F.contains(F.lower("id"), F.lit("test")).alias("test"), "ord"), "place", F.desc("in_degree"), "test", "ord").select("place", "id")


def evolution(commits: DataFrame, key: str) -> DataFrame:
    """Commits, authors and first and last day of each item."""
    return commits.groupBy(key).agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.min("day").alias("since"), F.max("day").alias("until"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """ST2: files whose content hash isn't in the manifest (path, sha)."""
    return files.join(manifest, ["path", "sha"], "left_anti")
