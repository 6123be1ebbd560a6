"""Projects of a source tree, their content hashes, and the commands that would index them.

Every language is a row of a table of parameters: its file extensions, the marker files of a project and the shape of its
indexer's command. Commands are only built; what they write is read by readers.symbol_index.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.sources.versions import safe_env


@dataclass(frozen=True)
class Adapter:
    """markers: patterns of file names that make a folder a project; nested: they are looked for in the folders of the root, too; fallback: the root is a project without any."""

    scheme: str
    extensions: tuple[str, ...]
    markers: tuple[str, ...]
    program: str
    arguments: tuple[str, ...]
    nested: bool = True
    fallback: bool = False


# Schemes, markers and command lines of public index builders ({project}: the folder, {output}: the index).
ADAPTERS = {
    "rust": Adapter("rust-analyzer", (".rs",), ("Cargo.toml",), "rust-analyzer", ("scip", "{project}", "--output", "{output}")),
    "typescript": Adapter("scip-typescript", (".ts", ".tsx", ".js", ".jsx", ".svelte"), ("package.json",), "scip-typescript", ("index", "--output", "{output}")),
    "python": Adapter("scip-python", (".py",), ("pyproject.toml", "setup.py"), "scip-python", ("index", "--project-name", "{project}", "--output", "{output}"), fallback=True),
    "java": Adapter("semanticdb", (".java", ".kt", ".scala"), ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "build.sbt"), "scip-java", ("index", "--output", "{output}")),
    "go": Adapter("scip-go", (".go",), ("go.mod",), "scip-go", ("--output", "{output}")),
    "ruby": Adapter("scip-ruby", (".rb", ".rake", ".gemspec"), ("Gemfile",), "scip-ruby", ("--index-file", "{output}", "--quiet")),
    "php": Adapter("scip-php", (".php",), ("composer.json",), "scip-php", ()),
    "dotnet": Adapter("scip-dotnet", (".cs", ".vb"), ("*.sln", "*.slnx", "*.csproj", "*.vbproj", "*.fsproj"), "scip-dotnet", ("index", "--output", "{output}")),
    "clang": Adapter("cxx", (".c", ".cc", ".cpp", ".cxx", ".cu", ".h", ".hh", ".hpp", ".hxx"), ("compile_commands.json",), "scip-clang", ("--compdb-path={project}/compile_commands.json", "--index-output-path={output}")),
    "dart": Adapter("scip-dart", (".dart",), ("pubspec.yaml",), "scip_dart", ("./",)),
}


def register(name: str, adapter: Adapter) -> None:
    """UD1: add a language, or replace one."""
    ADAPTERS[name] = adapter


def discover(paths: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """Lang, project (a folder, "" for the root) of each folder of the first two levels with a marker that has source files of the language below it. paths: path from the root."""
    adapters = adapters or ADAPTERS
    parts = F.split("path", "/")
    n, name, top = F.size(parts), F.element_at(parts, -1), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")
    marks = [F.when((n <= (2 if a.nested else 1)) & N.either([name.like(m.replace("_", "\\_").replace("*", "%")) for m in a.markers]), lang) for lang, a in adapters.items()]
    own = [F.when(N.extension(F.col("path")).isin(list(a.extensions)), lang) for lang, a in adapters.items()]
    marked = paths.select(top.alias("project"), F.explode(F.array_compact(F.array(*marks))).alias("lang")).distinct()
    holds = paths.select(F.explode(F.array_distinct(F.array(F.lit(""), top))).alias("project"), F.array_compact(F.array(*own)).alias("langs")).select("project", F.explode("langs").alias("lang")).distinct()
    found = marked.join(holds, ["lang", "project"], "left_semi").select("lang", "project")
    alone = holds.where((F.col("project") == "") & F.col("lang").isin([k for k, a in adapters.items() if a.fallback])).join(marked, "lang", "left_anti")
    return found.unionByName(alone.select("lang", "project"))


def content_hash(files: DataFrame, key: str = "project") -> DataFrame:
    """The first 16 digits of a hash over the sorted paths and contents of each project's files (project, path, content).

    Contents are hashed where they are read; only their digests meet.
    """
    digest = F.struct("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(digest)), lambda x: F.concat(x["path"], F.lit(":"), x["sha"])), "\n")
    return files.groupBy(key).agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("hash"))


def command(lang: str, project: str, output: str, extra: tuple[str, ...] = ()) -> list[str]:
    """SC1: the command that indexes a project. Extra arguments must be options."""
    a = ADAPTERS[lang]
    if any(not e.startswith("-") or "\0" in e for e in extra):
        raise ValueError(f"not options: {extra!r}")
    return [a.program, *(x.format(project=project or ".", output=output) for x in a.arguments), *extra]


@cache
def available(program: str, timeout: float = 5) -> str | None:
    """SC2: the first line that a program says of its version, or None if it isn't there."""
    if not shutil.which(program):
        return None
    try:
        done = subprocess.run([program, "--version"], capture_output=True, timeout=timeout, env=safe_env())
    except (OSError, subprocess.TimeoutExpired):
        return None
    return (done.stdout or done.stderr).decode("utf-8", "replace").split("\n")[0].strip() if not done.returncode else None


def status(probe: Callable[[str], str | None] = available) -> dict[str, str | None]:
    """SC2: the version of each language's index builder, or None."""
    return {lang: probe(a.program) for lang, a in ADAPTERS.items()}
