"""Symbol-index joins: references resolved by where they stand and by name, against the definitions of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N


def definitions(occurrences: DataFrame) -> DataFrame:
    """symbol, name, node, place of each symbol's first definition. occurrences: place (load order), file, symbol, line, is_definition."""
    first = occurrences.where("is_definition").groupBy("symbol").agg(F.min_by("file", "place").alias("file"), F.min("place").alias("place"))
    return first.select("symbol", N.symbol_name(F.col("symbol")).alias("name"), N.symbol_node(F.col("symbol"), F.col("file")).alias("node"), "place")


def by_location(refs: DataFrame, occurrences: DataFrame, defined: DataFrame, compat: bool = False) -> DataFrame:
    """Ord, candidate of the references (ord, file, lineno, ref) at whose line the index has a defined symbol of that name.

    A file that has nothing at that line is looked up once more without its first folder. Index lines begin at 0; compat compares them with
    the reference's own line, and the name with the whole reference in place of its last part.
    """
    simple = F.col("ref") if compat else F.substring_index(F.substring_index("ref", "::", -1), ".", -1)
    asked = refs.select("ord", "file", (F.col("lineno") - (0 if compat else 1)).alias("line"), simple.alias("wanted"))
    there = occurrences.select("file", "line", "symbol")
    known = asked.join(there.select("file", "line").distinct(), ["file", "line"], "left_semi")
    stripped = F.expr("substring(file, instr(file, '/') + 1)")
    rest = asked.join(known.select("ord"), "ord", "left_anti").where("instr(file, '/') > 0").withColumn("file", stripped)
    hits = known.unionByName(rest).join(there, ["file", "line"]).join(defined, "symbol").where("name = wanted")
    return hits.groupBy("ord").agg(F.min_by("node", "place").alias("candidate"))


def by_name(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """Ord, candidate by the last part of each reference: for a qualified one the first symbol that holds its type's name, else the first of that name.

    Names are reduced before they meet references: to one row, or to one for each type that is asked for.
    """
    name = F.substring_index(F.substring_index("ref", "::", -1), ".", -1)
    asked = refs.select("ord", name.alias("name"), F.lower(F.when(F.col("ref").contains("::"), F.element_at(F.split("ref", "::"), -2))).alias("of"))
    first = defined.where("name IS NOT NULL").groupBy("name").agg(F.min_by("node", "place").alias("first"))
    typed = asked.where("of <> ''").select("name", "of").distinct().join(defined, "name").where(F.contains(F.lower("symbol"), F.col("of")))
    typed = typed.groupBy("name", "of").agg(F.min_by("node", "place").alias("typed"))
    found = asked.join(first, "name").join(typed, ["name", "of"], "left")
    return found.select("ord", F.coalesce("typed", "first").alias("candidate"))


def candidates(refs: DataFrame, occurrences: DataFrame, compat: bool = False) -> DataFrame:
    """ord, candidate: by location, else by name."""
    defined = definitions(occurrences)
    here = by_location(refs, occurrences, defined, compat)
    return here.unionByName(by_name(refs, defined).join(here.select("ord"), "ord", "left_anti"))
