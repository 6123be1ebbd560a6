"""The tools over one graph. Each method gives a DataFrame; rendering to text is a separate last step (`render`)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph import schema, sinks
from loomgraph.config import Config
from loomgraph.functions import extract
from loomgraph.functions import names as N
from loomgraph.operators import crosslang, flow, graph, history, resolve, search, sections, symbols
from loomgraph.sources import readers, versions
from loomgraph.sources.versions import since, valid_ref  # noqa: F401
from loomgraph.storage import cut, numbered

Direction = Literal["forward", "backward"]
CrossLangMode = Literal["endpoint", "list", "stats"]
ChurnMode = Literal["symbols", "files", "co-change"]
HttpMethod = Literal["GET", "POST", "PUT", "DELETE", "PATCH"]
Language = Literal["rust", "typescript", "python", "svelte", "javascript", "all"]
SymbolType = Literal["function", "class", "method", "constant", "file", "all"]


def path_of(node: str) -> str:
    return node.removeprefix("FILE:")


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    vectors: DataFrame | None = None
    lines: DataFrame | None = None
    endpoints: DataFrame | None = None
    config: Config = Config()

    @classmethod
    def index(cls, spark: SparkSession, root: str, occurrences: DataFrame | None = None, words: list[str] | None = None, **more) -> Engine:
        """Scan, extract, keep the first node of each id, resolve references (by a symbol index first, if there is one), count what ends at each node."""
        files = readers.source_tree(spark, root)
        place = numbered(files.select("path", "order_key"), "place", "order_key").drop("order_key")  # without contents
        rows = extract.extract(files).join(place, "path").withColumn("ord", F.col("place") * 10_000_000 + F.col("ord"))
        named = ["type", "name", "lineno", "end_lineno", "path", *extract.DETAILS]
        nodes = rows.where("kind = 'node'").groupBy("id").agg(F.min_by(F.struct(*named), "ord").alias("n"), F.min("ord").alias("ord")).select("ord", "id", "n.*")
        edges = rows.where("kind = 'edge'").select("ord", "source", "target", "relation", "lineno")
        asked = edges.select("ord", N.file_of(F.col("source")).alias("file"), "lineno", F.expr("substring(target, 5)").alias("ref")).where(F.col("target").startswith("REF:"))
        known = symbols.candidates(asked, occurrences) if occurrences is not None else None
        found = resolve.resolve(nodes, edges, words or resolve.STDLIB, known).where("resolved IS NOT NULL").select("ord", "source", "target", "resolved").dropDuplicates(["ord", "source", "target"])
        edges = edges.join(found, ["ord", "source", "target"], "left")
        renamed = F.when(F.col("resolved").isNotNull() & F.col("relation").isin("CALLS", "INSTANTIATES"), F.concat("relation", F.lit("_RESOLVED"))).otherwise(F.col("relation"))
        edges = edges.select("ord", "source", F.coalesce("resolved", "target").alias("target"), renamed.alias("relation"), "lineno")
        return cls(nodes, edges, files, **more)

    @classmethod
    def ensure(cls, spark: SparkSession, root: str, path: str, max_age_hours: float | None = None, **more) -> Engine:
        """The graph saved at a path; it is built and saved first if it isn't there or too old."""
        config = more.get("config", Config())
        if sinks.fresh(spark, path, config.max_age_hours if max_age_hours is None else max_age_hours).first()["stale"]:
            cls.index(spark, root, config=config).save(path)
        return cls.load(spark, path, **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **more) -> Engine:
        """A graph that `save` wrote, or a graph document (.json, or a folder of export_graph)."""
        read = schema.saved_graph if schema.is_saved(spark, path) else schema.read_graph
        return cls(*read(spark, path), **more)

    def save(self, path: str) -> None:
        schema.write_graph(self.documents(), self.edges, path)

    def documents(self) -> DataFrame:
        """Nodes with what the filters and scores need."""
        path = N.file_of(F.col("id"))
        rows = self.nodes.drop("in_degree")
        rows = rows.withColumns({"crate": N.crate_of(path), "lang": N.lang_of(path), "is_test": N.is_test(path, F.col("type"), F.col("name"), self.config.test_dirs, self.config.test_suffixes, self.config.test_names)})
        return graph.in_degree(rows, self.edges)

    def status(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes")).join(self.edges.agg(F.count("*").alias("edges")))  # one row each

    def search(self, terms: list[str], limit: int | None = None, **filters) -> DataFrame:
        """Keyword search; with vectors, questions and poor results are fused with vector search. Hits of vectors alone are left out."""
        limit = limit or self.config.search_limit
        found = search.search(self.documents(), terms, 2 * limit, **filters)
        return found.limit(limit)

    def hybrid(self, terms: list[str], vector: list[float], limit: int | None = None, **filters) -> DataFrame:
        limit = limit or self.config.search_limit
        words = search.search(self.documents(), terms, 2 * limit, **filters)
        asks = self.nodes.sparkSession.range(1).select(N.is_question(F.array(*map(F.lit, terms))).alias("q")).first()["q"]
        if self.vectors is None or not asks and words.count() >= 3:
            return words.select("id", "score").limit(limit)
        near = search.nearest(self.vectors, vector, 2 * limit, self.config.hybrid_least)
        if near.isEmpty():
            return words.select("id", "score").limit(limit)
        fused = search.fuse(search.ranked(words, F.desc("score"), "ord"), search.ranked(near, F.desc("score"), "id"))
        return fused.join(words.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)

    def semantic(self, vector: list[float], limit: int | None = None) -> DataFrame:
        return search.nearest(self.vectors, vector, limit or self.config.search_limit, self.config.semantic_least)

    def callers(self, name: str, limit: int | None = None) -> DataFrame:
        return graph.callers(self.nodes, self.edges, name, limit or self.config.callers_limit)

    def callees(self, name: str, limit: int | None = None) -> DataFrame:
        return graph.callees(self.nodes, self.edges, name, limit or self.config.callers_limit)

    def _first(self, name: str) -> DataFrame:
        return graph.lookup(self.nodes, name).withColumn("rank", N.type_rank(F.col("type"))).orderBy("rank", "ord").limit(1)

    def _start(self, name: str) -> DataFrame:
        """The first function of a name, or the first node of it; by similar names if none has it."""
        rank = F.when(F.col("type").isin("Function", "Method"), 0).otherwise(1)
        return graph.lookup(self.nodes, name).withColumn("rank", rank).orderBy("rank", "ord").limit(1).select("id")

    def flow(self, name: str, direction: Direction = "forward", depth: int = 3, target: str | None = None) -> DataFrame:
        """The call tree in the order of a depth-first visit, to bounded depth, children and nodes."""
        rows = flow.tree(self.nodes, self.edges, self._start(name), direction, min(depth, self.config.max_depth), target, self.config.max_children, self.config.max_nodes)
        return rows.join(self.nodes.select("id", "name", "type", "token_count", "lineno"), "id", "left").orderBy("ord")

    def alternatives(self, name: str, limit: int = 5) -> DataFrame:
        """The symbol that a name is taken to mean (place 0) and the next ones, in the order of the graph."""
        rows = graph.lookup(self.nodes, name)
        only = rows.where(F.col("type").isin("Function", "Method"))
        rows = rows if only.isEmpty() else only
        return search.ranked(rows.orderBy("ord").limit(limit + 1), "ord").select(F.col("rank").alias("place"), "id", "name", N.file_of(F.col("id")).alias("file"))

    def expand(self, node_id: str, budget: int = 2000, depth: int = 1) -> DataFrame:
        """What a node calls, small code inlined while it fits the budget."""
        start = self.nodes.where(F.col("id") == node_id).select("id")
        return flow.expansion(self.nodes, self.edges, start, budget, min(depth, 3), children=self.config.max_children, most=self.config.max_nodes).orderBy("ord")

    def path(self, start: str, end: str, depth: int = 3, direction: Direction = "forward") -> DataFrame:
        """The shortest path between two names, with a status: found, or none within the depth."""
        edges = self.edges if direction == "forward" else self.edges.withColumns({"source": F.col("target"), "target": F.col("source")})
        rows = graph.reachable(edges, self._first(start).select("id"), graph.CALLS, min(depth, self.config.max_depth))
        ends = graph.lookup(self.nodes, end, fuzzy=False).select("id")
        best = rows.where("steps > 0").join(ends, "id", "left_semi").orderBy("steps", "ords").limit(1)
        one = self.nodes.sparkSession.range(1)
        return one.join(best, how="left").select(F.when(F.col("path").isNull(), "none").otherwise("found").alias("status"), "path", "steps")

    def structure(self, file: str) -> DataFrame:
        """type, n, shown: imports, names by type and configurations of a file."""
        node = file if file.startswith("FILE:") else f"FILE:{file}"
        own = graph.definitions(self.nodes, self.edges.where(F.col("source") == node)).select("type", "n", "shown")
        inside = graph.structure(self.nodes, self.edges, node).join(own.select("type"), "type", "left_anti").select("type", "n", "shown")
        modules = graph.imports(self.edges.where(F.col("source") == node)).select(F.lit("Imports").alias("type"), "n", "shown")
        return modules.unionByName(own).unionByName(inside)

    def flatten(self, class_id: str) -> DataFrame:
        return graph.flatten(self.nodes, self.edges).where(F.col("id") == class_id).orderBy("name")

    def impls(self, method: str, trait: str | None = None) -> DataFrame:
        return graph.impls(self.nodes, method, trait)

    def resolve_id(self, query: str) -> DataFrame:
        """An id as it is, as a file, or the one clearly best candidate; else up to five suggestions (status)."""
        exact = self.nodes.where(F.col("id").isin(query, f"FILE:{query}")).select("id", F.lit(1000).alias("score"))
        rows = exact.unionByName(graph.similar_nodes(self.nodes, query).select("id", "score"))
        rows = search.ranked(rows.groupBy("id").agg(F.max("score").alias("score")), F.desc("score"), "id").withColumn("next", F.lead("score").over(W.orderBy("rank")))
        sure = (F.col("rank") == 0) & (F.col("next").isNull() | (F.col("score") >= 80) & (F.col("score") > F.col("next") + 20))
        return rows.select("id", "score", F.when(sure, "resolved").otherwise("suggestion").alias("status"))

    def _source(self, nodes: DataFrame, full: bool = False, head_lines: int | None = None) -> DataFrame:
        """id, lines of some nodes."""
        own = nodes.select("id", N.file_of(F.col("id")).alias("path"), "lineno", "end_lineno", "token_count").join(self.files, "path")
        lines = F.slice(F.split("content", "\n"), F.col("lineno"), F.greatest(F.lit(1), F.col("end_lineno") - F.col("lineno") + 1))
        return own.select("id", (lines if full else N.head_tail(lines, F.col("token_count"), head_lines)).alias("lines"))

    def context(self, node_id: str, max_output_tokens: int | None = None, brief: bool = False, full: bool = False, depth: int = 1, expand: bool = False, head_lines: int | None = None, callee_budget: int = 2000) -> DataFrame:
        """section, text of what there is to know of a node. If it is longer than max_output_tokens, sections are shortened or left out step by step."""
        node, name, file = self.nodes.where(F.col("id") == node_id), node_id.split("::")[-1], node_id.split("::")[0]
        listed = lambda df, text: df.agg(F.array_sort(F.collect_list(text)).alias("lines"))
        parts = [("symbol", node.select(F.array(F.concat_ws(" ", "type", "name", F.col("lineno").cast("string"), "signature")).alias("lines")))]
        if self.files is not None and not brief:
            parts.append(("source", self._source(node, full, head_lines).select("lines")))
        callers = graph.callers_summary(self.nodes, self.edges, node_id)
        parts.append(("callers", listed(callers, F.concat("id", F.lit(" ("), F.coalesce("token_count", F.lit(0)).cast("string"), F.lit(" toks)")))))
        if not brief:
            if depth > 1:
                nested = self.expand(node_id, callee_budget, depth)
                rows = nested.select(F.format_string("%05d %s%s (%s)", "ord", F.repeat(F.lit("  "), (F.col("steps") - 1).cast("int")), "id", "mode").alias("x"))
                parts.append(("callees", rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.substring(x, 7, 1000)).alias("lines"))))
            else:
                parts.append(("callees", listed(self.edges.where((F.col("source") == node_id) & F.col("relation").isin(graph.CALLS)).select("target").distinct(), F.col("target"))))
            if expand and self.files is not None:
                calls = self.edges.where((F.col("source") == node_id) & F.col("relation").isin("CALLS", "CALLS_RESOLVED")).groupBy("source", F.col("target").alias("id")).agg(F.min("ord").alias("ord"))
                taken = graph.greedy_budget(calls.join(self.nodes.select("id", "token_count"), "id"), "source", callee_budget).select(F.explode(F.split("taken", ",")).alias("id"))
                code = self._source(self.nodes.join(taken, "id", "left_semi"), full=True)
                parts.append(("expanded", code.select(F.concat(F.array("id"), "lines").alias("x")).agg(F.flatten(F.array_sort(F.collect_list("x"))).alias("lines"))))
            parts.append(("tests", listed(graph.related_tests(self.nodes, name, path_of(file)), F.col("id"))))
            parts.append(("examples", listed(graph.usage_examples(self.edges, name), F.concat_ws(" -> ", "source", "target"))))
            parts.append(("configs", listed(graph.related_configs(self.nodes, self.edges, file, node_id), F.concat_ws(" ", F.col("lineno").cast("string"), "signature"))))
        out = None
        for k, (title, part) in enumerate(parts):
            row = part.select(F.lit(1).alias("key"), F.lit(k).alias("ord"), F.lit(title).alias("section"), "lines")
            out = row if out is None else out.unionByName(row)
        kept = sections.truncated(out, max_output_tokens or self.config.max_output_tokens)
        return kept.orderBy("ord").select("section", F.array_join("lines", "\n").alias("text"))

    def quick(self, name: str, full: bool = False, brief: bool = False) -> DataFrame:
        found = self._first(name).first()
        return self.context(found["id"] if found else "", full=full, brief=brief)

    def source(self, path: str, line: int | None = None) -> DataFrame:
        """The lines of a file around a line."""
        return readers.window(self.files.where(F.col("path") == path), F.lit(line) if line else None)

    def examples(self) -> DataFrame:
        return graph.examples(self.nodes, self.edges)

    def _spans(self) -> DataFrame:
        spans = self.nodes.where(F.col("type").isin("Function", "Method", "Class") & F.col("lineno").isNotNull())
        return spans.select(N.file_of(F.col("id")).alias("file"), F.col("lineno").alias("start"), F.coalesce("end_lineno", "lineno").alias("end"), "id", "ord")

    def _history(self, time_range: str | None, path: str | None, exclude: bool = True, today: str | None = None, after: str | None = None) -> DataFrame:
        """The changed lines of a time range and a path; without a path all but generated files."""
        lines = history.in_paths(self.lines, path, self.config.excluded) if path or exclude else self.lines
        return history.in_range(lines, time_range, today or date.today().isoformat(), after)

    def churn(self, mode: ChurnMode = "symbols", limit: int | None = None, time_range: str | None = None, path: str | None = None, exclude_generated: bool = True, today: str | None = None) -> DataFrame:
        """Symbols of the most changed files (the code files themselves, if no symbol holds a change), files, or pairs that change together (of files where no symbols do)."""
        limit, lines = limit or self.config.churn_limit, self._history(time_range, path, exclude_generated, today)
        if mode == "files":
            return history.file_churn(lines, limit)
        if mode == "symbols":
            return history.symbol_churn_or_files(lines, self._spans(), self.config.churn_files).orderBy(F.desc("commits"), "id").limit(limit)
        hit = history.attribute(lines.select("sha", "file", "line").distinct(), self._spans())
        pairs = history.co_change(hit, "id", self.config.min_together)
        if pairs.isEmpty():
            pairs = history.co_change(lines.where(N.is_code(F.col("file"))), "file", self.config.min_together)
        return pairs.orderBy(F.desc("together"), "a", "b").limit(limit)

    def evolution(self, name: str, time_range: str | None = None, crate: str | None = None, today: str | None = None) -> DataFrame:
        """Commits, authors and days of the symbol that a name stands for: the one with most callers, of the crate if any is."""
        matches = graph.in_degree(graph.lookup(self.nodes, name).drop("tier", "in_degree"), self.edges)
        best = history.pick(matches, crate).where("place = 0").select("id")
        hit = history.attribute(self._history(time_range, None, False, today).select("sha", "author", "day", "file", "line").distinct(), self._spans())
        return history.evolution(hit.join(best, "id", "left_semi"), "id")

    def commits(self, root: str, name: str, time_range: str | None = None, crate: str | None = None, limit: int = 10) -> DataFrame:
        """G14 from version control itself: the commits of the symbol that a name stands for, newest first."""
        matches = graph.in_degree(graph.lookup(self.nodes, name).drop("tier", "in_degree"), self.edges)
        best = history.pick(matches, crate).where("place = 0").join(self.nodes.select("id", "name", "lineno", "end_lineno"), "id").first()
        if best is None:
            raise ValueError(f"no symbol {name!r}")
        span = (best["lineno"], best["end_lineno"]) if best["lineno"] and best["end_lineno"] else None
        found = versions.symbol_history(self.nodes.sparkSession, root, path_of(best["id"].split("::")[0]), best["name"], span, time_range)
        return found.orderBy("place").limit(limit)

    def changes(self, limit: int | None = None, time_range: str | None = None, path: str | None = None, show_callers: bool = True, today: str | None = None) -> DataFrame:
        """Touched symbols with their first five callers, all in one join."""
        touched = history.impact(self._history(time_range, path, False, today), self._spans(), limit or self.config.changes_limit)
        if not show_callers:
            return touched.orderBy(F.desc("changed"), "id")
        calls = self.edges.where(F.col("relation").isin(graph.CALLS)).select(F.col("target").alias("id"), "source").distinct()
        rank = F.row_number().over(W.partitionBy("id").orderBy("source"))
        five = calls.join(touched.select("id"), "id", "left_semi").withColumn("k", rank).where("k <= 5").groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("callers"))
        return touched.join(five, "id", "left").orderBy(F.desc("changed"), "id")

    def change_totals(self, time_range: str | None = None, path: str | None = None, today: str | None = None) -> DataFrame:
        return history.impact_totals(self._history(time_range, path, False, today), self._spans())

    def cross_lang(self, mode: CrossLangMode = "list", requests: DataFrame | None = None, tag: str | None = None) -> DataFrame:
        linked = crosslang.handlers(self.endpoints, self.nodes, list(self.config.handlers) or None)
        if mode == "endpoint":
            return crosslang.match(requests, self.endpoints)
        return crosslang.stats(linked) if mode == "stats" else crosslang.listed(linked, tag)


    def health(self, path: str | None = None) -> DataFrame:
        """Counts, age and what is there to work with, one row."""
        out = self.status().withColumns({"vectors": F.lit(self.vectors is not None), "history": F.lit(self.lines is not None), "endpoints": F.lit(self.endpoints is not None)})
        return out.join(sinks.fresh(self.nodes.sparkSession, path, self.config.max_age_hours)) if path else out  # one row each


def render(df: DataFrame, title: str, most: int = 500, nodes: int | None = None, edges: int | None = None, age_hours: float | None = None, most_hours: float = 24.0) -> str:
    """K4: a text report of at most `most` lines of a bounded result, under the size and age of the graph if they are given."""
    rows = df.limit(most + 1).collect()
    body = [" | ".join("" if v is None else str(v) for v in r) for r in rows[:most]]
    head = [] if nodes is None else [f"[{nodes:,}n/{edges:,}e" + ("" if age_hours is None else f" | {age_hours:.1f}h ago{' STALE' if age_hours > most_hours else ''}") + "]", ""]
    return "\n".join([*head, f"# {title}", " | ".join(df.columns), *body, *(["... more"] if len(rows) > most else [])])


#: Lines that a report of each tool may have, where it isn't 500.
REPORT_LINES = {"flow": 300, "flatten": 150, "context": 2000}
