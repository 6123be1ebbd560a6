"""Sections of a report on a symbol, and what is left out of them when the report is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N

#: What is given up, in this order, until the report fits: a section (0 lines) or all but its first lines.
LADDER = [("expanded", 0), ("examples", 2), ("tests", 0), ("configs", 0), ("callers", 5), ("callees", 5), ("source", 30)]


def shortened(lines: Column, most: int) -> Column:
    """The first lines and how many more there are."""
    more = F.concat(F.lit("... ("), (F.size(lines) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most), F.array(more))).otherwise(lines)


def truncated(sections: DataFrame, most_tokens: int, ladder: list[tuple[str, int]] = LADDER) -> DataFrame:
    """Key, ord, section, lines, steps of reports (key, ord, section, lines) of at most most_tokens tokens, if the ladder's steps get there.

    Each step is a function of the section alone, so the length after any number of steps is a sum over sections; the fewest steps that fit
    are taken (all, if none do), for each report.
    """
    place = {name: k for k, (name, _) in enumerate(ladder, 1)}
    step = F.lit(len(ladder) + 1)
    cut = F.col("lines")
    for name, most in ladder:
        here = F.col("section") == name
        step = F.when(here, place[name]).otherwise(step)
        cut = F.when(here, shortened(F.col("lines"), most) if most else F.array().cast("array<string>")).otherwise(cut)
    rows = sections.withColumns({"step": step, "short": cut})
    size = lambda c: F.coalesce(F.char_length(F.array_join(c, "\n")) + 1, F.lit(0)) * (F.size(c) > 0).cast("int")
    sums = [F.sum(F.when(F.col("step") <= k, size(F.col("short"))).otherwise(size(F.col("lines")))).alias(f"s{k}") for k in range(len(ladder) + 1)]
    fit = F.lit(len(ladder))
    for k in reversed(range(len(ladder))):
        fit = F.when(F.floor(F.col(f"s{k}") / 4) <= most_tokens, k).otherwise(fit)
    taken = rows.groupBy("key").agg(*sums).select("key", fit.alias("steps"))
    out = rows.join(taken, "key").withColumn("lines", F.when(F.col("step") <= F.col("steps"), F.col("short")).otherwise(F.col("lines")))
    return out.where(F.size("lines") > 0).select("key", "ord", "section", "lines", "steps")


def rendered(sections: DataFrame) -> DataFrame:
    """key, text: the sections of each report under their names."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "section", "lines")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("#### "), p["section"], F.lit("\n"), F.array_join(p["lines"], "\n"))), "\n\n")
    return sections.groupBy("key").agg(text.alias("text")).select("key", "text", N.estimate_tokens(F.col("text")).alias("tokens"))
