"""Scalar functions over names, ids, paths and texts; all of them column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How test code is told from other code.
TEST_DIRS = ["/tests/", "/test/", "/_test/", "/spec/", "/testing/", "/fixtures/", "/mocks/", "/__tests__/"]
TEST_SUFFIXES = ["_test.rs", ".test.ts", ".spec.ts", "_test.py", ".test.js", ".spec.js", ".test.tsx", ".spec.tsx"]
TEST_NAME = "^(test_|it_|describe_|spec_)"
# Language of a file extension, for filters.
LANGS = {".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".svelte": "svelte", ".proto": "protobuf"}
# Phrases and first words of questions in natural language.
PHRASES = ["how to", "what is", "where is", "where are", "find the", "show me", "get the", "look for", "search for", "related to", "that handles", "that does", "responsible for", "used for", "deals with"]
QUESTIONS = ["how", "what", "where", "why", "which", "find"]
TOKEN = r"[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_]*"


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalize_name(name: Column) -> Column:
    """camelCase, PascalCase and acronyms to snake_case."""
    humps = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(humps, "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def name_variants(name: Column) -> Column:
    """The name, its snake_case form if that differs from plain lower case, and its lower case; distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(name, F.when(normalize_name(name) != F.lower(name), normalize_name(name)), F.lower(name)))))


def clean_ref(ref: Column, most: int = 60) -> Column:
    """A short name for an unresolved reference: its first line, its leading A::B path, or its last dotted part that begins a name."""
    line = F.trim(F.substring_index(ref, "\n", 1))
    path = F.regexp_extract(line, "^([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+)", 1)
    parts = F.filter(F.transform(F.reverse(F.split(line, r"\.")), lambda p: F.regexp_extract(p, "^([a-zA-Z_][a-zA-Z0-9_]*)", 1)), lambda p: p != "")
    short = F.when(line.contains("::"), F.when(path != "", path).otherwise(line)).when(line.contains("."), F.coalesce(F.get(parts, F.lit(0)), line)).otherwise(line)
    return F.when(F.char_length(short) > most, F.concat(F.substring(short, 1, most - 3), F.lit("..."))).otherwise(short)


def tokens(text: Column) -> Column:
    """Identifier-like tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def file_of(node_id: Column) -> Column:
    return F.regexp_replace(F.substring_index(node_id, "::", 1), "^FILE:", "")


def crate_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def lang_of(path: Column) -> Column:
    found = F.lit(None).cast("string")
    for ext, lang in reversed(LANGS.items()):
        found = F.when(path.endswith(ext), lang).otherwise(found)
    return found


def is_test(path: Column, type_: Column, name: Column, dirs: list[str] = TEST_DIRS, suffixes: list[str] = TEST_SUFFIXES, pattern: str = TEST_NAME) -> Column:
    """whether a symbol is test code; its rules are parameters (UD2)."""
    in_file = either([path.contains(d) for d in dirs] + [path.endswith(s) for s in suffixes] + [F.lit(False)])
    return in_file | (type_.isin("Function", "Method") & name.rlike(pattern))


def is_question(terms: Column) -> Column:
    """Whether search terms (an array) are natural language and not code."""
    text = F.lower(F.array_join(terms, " "))
    asks = either([text.contains(p) for p in PHRASES]) | F.coalesce(F.lower(F.get(terms, F.lit(0))).isin(QUESTIONS), F.lit(False))
    return F.when(asks, True).when(text.rlike("[a-z]+_[a-z]+") | text.contains("::"), False).otherwise(F.size(terms) >= 3)


def type_rank(type_: Column) -> Column:
    return F.when(type_.isin("Function", "Method"), 0).when(type_ == "Class", 1).otherwise(2)


def head_tail(lines: Column, token_count: Column, head_lines: int | None = None) -> Column:
    """The lines of a large symbol without its middle; short ones whole. head_lines: only so many, whatever the size."""
    if head_lines:
        cut_off = F.concat(F.lit("... ("), (F.size(lines) - head_lines).cast("string"), F.lit(" more lines)"))
        return F.when(F.size(lines) <= head_lines, lines).otherwise(F.concat(F.slice(lines, 1, head_lines), F.array(cut_off)))
    n = F.size(lines)
    head = F.when(token_count < 1800, 60).otherwise(50)
    whole = (token_count < 1000) | (n <= 100) | (n <= head + 20)
    gap = F.array(F.concat(F.lit("... ("), (n - head - 15).cast("string"), F.lit(" more lines)")))
    return F.when(whole, lines).otherwise(F.concat(F.slice(lines, F.lit(1), head), gap, F.slice(lines, -15, 15)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; zero vectors count as of length one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = lambda x: F.when(dot(x, x) == 0, F.lit(1.0)).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (length(a) * length(b))


#: Which descriptors the first word of a symbol announces; words that are no names in backtick-style ones.
FAMILIES = {"rust-analyzer": "path", "semanticdb": "java", "scip-typescript": "backtick", "scip-python": "backtick", "scip-go": "backtick", "scip-ruby": "backtick", "scip-php": "backtick", "scip-dotnet": "backtick", "cxx": "backtick", "scip-dart": "backtick"}
NO_NAMES = ["export", "default", "async", "function", "class", "interface", "type", "const", "let", "var"]
DESCRIPTOR = r"[a-zA-Z_$][a-zA-Z0-9_$]*(?:\([^)]*\)|[#./\[\]])?"


def descriptor_names(raw: Column, family: str) -> Column:
    """The name parts of descriptors; packages and modules (before a slash) are left out.

    path: "impl" is no name, and no name has a dollar sign; backtick: only what follows the last quoted file, without keywords and names right before a type parameter.
    """
    if family == "backtick":
        tail = F.substring_index(raw, "`", -1)
        raw = F.regexp_replace(F.when(raw.contains("`") & (tail != ""), tail).otherwise(raw), "^/+", "")
    pattern = DESCRIPTOR.replace("$", "") if family == "path" else DESCRIPTOR
    left_out = {"path": ["/"], "backtick": ["/", "["], "java": ["/"]}[family]
    found = F.filter(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), lambda x: ~F.right(x, F.lit(1)).isin(left_out))
    names = F.transform(found, lambda x: F.regexp_extract(x, "^([a-zA-Z0-9_$]+)", 1))
    skipped = {"path": ["impl"], "backtick": NO_NAMES, "java": []}[family]
    return F.filter(names, lambda x: ~x.isin(skipped)) if skipped else names


def symbol_parts(symbol: Column) -> Column:
    """The name parts of a whole symbol (scheme, manager, package, version, descriptors), by the family of its scheme; none for local ones."""
    words = F.split(symbol, r"\s+")
    raw = F.array_join(F.slice(words, F.lit(5), F.greatest(F.lit(0), F.size(words) - 4)), " ")
    scheme, out = F.get(words, F.lit(0)), descriptor_names(raw, "path")
    for family in ("backtick", "java"):
        out = F.when(scheme.isin([k for k, v in FAMILIES.items() if v == family]), descriptor_names(raw, family)).otherwise(out)
    return F.when(symbol.startswith("local ") | (F.size(words) < 5), F.array().cast("array<string>")).otherwise(out)


def symbol_name(symbol: Column) -> Column:
    """The simple name of a symbol, or null."""
    parts = symbol_parts(symbol)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def symbol_node(symbol: Column, file: Column) -> Column:
    """The node id of a symbol defined in a file. The package goes before the path unless it holds a slash, is a dot, or is there already."""
    words = F.split(symbol, r"\s+")
    package = F.get(words, F.lit(2))
    plain = (F.size(words) < 4) | package.contains("/") | (package == ".") | F.startswith(file, F.concat(package, F.lit("/")))
    path = F.when(plain, file).otherwise(F.concat_ws("/", package, file))
    return F.concat_ws("::", F.concat(F.lit("FILE:"), path), F.when(F.size(symbol_parts(symbol)) > 0, F.array_join(symbol_parts(symbol), "::")))


# Highlighting language of a file extension.
SYNTAX = {".rs": "rust", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".svelte": "svelte", ".proto": "protobuf", ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".php": "php", ".cs": "csharp", ".vb": "vbnet", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cu": "cuda", ".h": "c", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".go": "go", ".java": "java", ".kt": "kotlin", ".scala": "scala", ".dart": "dart", ".css": "css", ".scss": "scss", ".html": "html"}
# Family of languages that resolve each other's names, by file extension.
FAMILY = {"rust": [".rs"], "typescript": [".ts", ".tsx", ".js", ".jsx", ".svelte"], "python": [".py"], "proto": [".proto"], "java": [".java", ".kt", ".scala"], "go": [".go"], "ruby": [".rb", ".rake", ".gemspec"], "php": [".php"], "dotnet": [".cs", ".vb"], "clang": [".c", ".cc", ".cpp", ".cxx", ".cu", ".h", ".hh", ".hpp", ".hxx"], "dart": [".dart"]}
# Extensions of code files in history reports, and paths that history reports leave out.
CODE = [".rs", ".py", ".ts", ".tsx", ".js", ".jsx", ".svelte", ".go", ".java", ".kt", ".scala", ".rb", ".rake", ".gemspec", ".php", ".cs", ".vb", ".c", ".cc", ".cpp", ".cxx", ".cu", ".h", ".hh", ".hpp", ".hxx", ".dart", ".css", ".scss", ".html"]
EXCLUDED = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
# Names of files that often hold credentials.
SENSITIVE = r"(?i)(^|/)\.env(\.|$)|(^|/)\.envrc$|(^|/)\.git/|(^|/)\.ssh/|(^|/)\.aws/|(^|/)\.gnupg/|(^|/)\.netrc$|(^|/)\.npmrc$|(^|/)\.pypirc$|(^|/)id_(rsa|dsa|ecdsa|ed25519)(\.|$)|\.(pem|key|p12|pfx|jks|keystore|asc|gpg)$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]*)$", 1))


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def syntax_lang(path: Column, more: dict[str, str] | None = None) -> Column:
    """The highlighting language of a path; empty if unknown. more: extensions that add to the table or replace its own."""
    return F.coalesce(looked_up(extension(path), SYNTAX | (more or {})), F.lit(""))


def family_of(path: Column) -> Column:
    """C8"""
    return F.coalesce(looked_up(extension(path), {e: k for k, es in FAMILY.items() for e in es}), F.lit("unknown"))


def is_code(path: Column, extensions: list[str] = CODE) -> Column:
    """F10"""
    return extension(path).isin(extensions)


def is_sensitive(path: Column) -> Column:
    """whether a path (with slashes) names something that often holds credentials."""
    return path.rlike(SENSITIVE)


def is_text(sample: Column) -> Column:
    """whether the first bytes of a file look like text: at most one in a hundred is zero, and they are UTF-8 (the last character may be cut), or begin with the mark of UTF-16."""
    plain = F.decode(sample, "ISO-8859-1")
    zeros = F.char_length(plain) - F.char_length(F.translate(plain, "\0", ""))
    marked = F.substring(F.hex(sample), 1, 4).isin("FFFE", "FEFF")
    whole = either([F.is_valid_utf8(F.substring(sample, F.lit(1), F.greatest(F.lit(0), F.length(sample) - k)).cast("string")) for k in range(4)])
    return marked | (zeros <= F.length(sample) * 0.01) & whole


def location(node_id: Column, lineno: Column) -> Column:
    file = F.when(node_id.startswith("FILE:"), file_of(node_id))
    return F.when(file.isNull() | (file == ""), node_id).when(lineno.isNotNull(), F.concat(file, F.lit(":"), lineno.cast("string"))).otherwise(file)


def compact_line(rank: Column) -> Column:
    """One line of a list of symbols: rank, type, name, last two path segments, tokens and callers."""
    parts = F.split(file_of(F.col("id")), "/")
    short = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "/")
    where = F.when(F.coalesce("lineno", F.lit(0)) > 0, F.concat(short, F.lit(":"), F.col("lineno").cast("string"))).otherwise(short)
    return F.format_string("%d. [%s] %s | %s (%dt, %dc)", rank, F.substring("type", 1, 3), F.coalesce("name", F.lit("unknown")), where, F.coalesce("token_count", F.lit(0)), F.coalesce("in_degree", F.lit(0)))


def full_lines() -> Column:
    """A symbol with its place, size, signature and the first line of its description (at most 120 characters)."""
    tokens, degree = F.coalesce("token_count", F.lit(0)), F.coalesce("in_degree", F.lit(0))
    size = F.when((tokens > 0) | (degree > 0), F.format_string(" (%d toks, %d callers)", tokens, degree)).otherwise("")
    first = F.get(F.filter(F.transform(F.split(F.coalesce("docstring", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0))
    shown = F.when(F.char_length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("..."))).otherwise(first)
    head = F.concat(F.format_string("[%s] %s | ", F.substring("type", 1, 3), F.coalesce("name", F.lit("unknown"))), location(F.col("id"), F.col("lineno")), size)
    more = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("      "), x))
    return F.concat_ws("\n", head, more(F.col("signature")), more(shown))


def dedup_key(node_id: Column) -> Column:
    """C18"""
    return F.md5(node_id.cast("binary"))


def age_hours(now: Column, then: Column) -> Column:
    """C17: hours between two timestamps."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 3_600_000_000


def is_stale(now: Column, then: Column, most_hours: float) -> Column:
    """C17: whether something is missing or older than the limit."""
    return F.coalesce(age_hours(now, then) > most_hours, F.lit(True))
