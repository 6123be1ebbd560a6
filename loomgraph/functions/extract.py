"""Symbols and references of source files: one file is one call, so a file is never split; runs over files in Arrow batches.

Python goes through its own parser. The other languages share one line scanner that is driven by a table of patterns: it strips
line comments outside of strings, follows braces (or indents), and records definitions, imports, inheritance and calls.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.functions import details
from loomgraph.functions.vocabulary import KEYWORDS_OF

SCHEMA = "kind string, ord long, id string, type string, name string, lineno int, end_lineno int, source string, target string, relation string"
#: What more a node says; null for edges.
DETAILS = {"signature": "string", "docstring": "string", "value": "string", "trait_impl": "string", "return_type": "string", "param_types": "array<string>", "token_count": "int"}
SCHEMA += "".join(f", {k} {t}" for k, t in DETAILS.items())
CALL = re.compile(r"([A-Za-z_][\w]*(?:(?:::|\??\.|->)[A-Za-z_]\w*[?!]?)*)\s*\(")
#: A type and a name before a parenthesis: a declaration, whether or not it becomes a node.
TYPED = re.compile(r"^\s*(?P<first>[A-Za-z_]\w*)[\w<>\[\],.?&*:\s]*?[\s&*]~?(?P<n>[A-Za-z_]\w*)\s*\(")
# Marks of generated files near their top, by convention of the tools that write them.
GENERATED = ["// Code generated ", "DO NOT EDIT", "/* Automatically generated", "/* This file was generated", "# This file was automatically generated", "# This file is autogenerated", "# Generated by ", "# AUTO-GENERATED", "# Automatically generated", "// This file was automatically generated", "// This file is autogenerated", "// Generated by ", "// @generated", "@Generated", "/** @codegen"]
#: Languages whose calls are recorded in generated files too.
ALWAYS = ("python", "rust", "typescript", "svelte")
#: How many lines a declaration may take until its body begins.
AHEAD = 10
SELF_LIKE = {"self", "this", "super", "parent", "static", "base", "Self"}
ANY_KEYWORD = KEYWORDS_OF["java"]  # of a language without keywords of its own


@dataclass(frozen=True)
class Language:
    """Patterns with a group `n` for the name; `up` in a class pattern is what it inherits."""

    extensions: tuple[str, ...]
    classes: str
    functions: str
    imports: str
    constants: str = r"$^"
    comment: str = "//"
    blocks: str = "{}"
    fields: str = r"$^"  # constants that stand inside of a class only
    accessors: str = r"$^"  # names after a colon are methods
    group: str = r"$^"  # begins a group of constants in parentheses
    constructor: str = ""  # a method named like its class; its node's name
    typed: bool = False  # a declaration has a type before its name, and its brace may come on a later line


NAME = r"(?P<n>[A-Za-z_]\w*)"
LANGUAGES = {
    "rust": Language((".rs",), rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|mod)\s+{NAME}|^\s*impl(?:<[^>]*>)?\s+(?:(?P<up>[A-Z]\w*)(?:<[^>]*>)?\s+for\s+)?(?P<impl>[A-Z]\w*)", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{NAME}", r"^\s*(?:pub\s+)?use\s+(?P<n>[\w:]+)", rf"^\s*(?:pub\s+)?(?:const|static)\s+(?P<n>[A-Z][A-Z0-9_]*)"),
    "typescript": Language((".ts", ".tsx", ".js"), rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+{NAME}(?:\s+extends\s+(?P<up>[A-Z]\w*))?", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}|^\s*(?:export\s+)?const\s+(?P<n2>[A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>|^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?P<n3>[A-Za-z_]\w*)\s*\([^)]*\)[^;{{]*\{{", r"^\s*import\b.*?from\s+['\"](?P<n>[^'\"]+)", rf"^\s*(?:export\s+)?const\s+(?P<n>[A-Z][A-Z0-9_]*)\s*[:=]"),
    "java": Language((".java",), rf"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+{NAME}(?:<[^>]*>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<up>[A-Z]\w*))?", rf"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.?]+(?:\s*<[^>]*>)?\s+{NAME}\s*\(", r"^\s*import\s+(?:static\s+)?(?P<n>[\w.]+)", fields=rf"^\s*(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w<>\[\],.? ]+\s+{NAME}\s*(?:=|;)", constructor="<init>", typed=True),
    "go": Language((".go",), rf"^\s*(?:type\s+)?{NAME}\s+(?:struct|interface)\b|^\s*type\s+(?P<n2>[A-Za-z_]\w*)\s+\S", rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?{NAME}\s*[\(\[]", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<n>[^\"]+)\"\s*$", rf"^(?:const|var)\s+{NAME}", group=r"^\s*(?:const|var)\s*\(\s*$"),
    "ruby": Language((".rb", ".rake", ".gemspec"), rf"^\s*(?:class|module)\s+(?:\w+::)*{NAME}(?:\s*<\s*(?:\w+::)*(?P<up>[A-Z]\w*))?", r"^\s*def\s+(?:self\.)?(?P<n>[A-Za-z_]\w*[?!=]?)", r"^\s*require(?:_relative)?\s+['\"](?P<n>[^'\"]+)", r"^\s*(?P<n>[A-Z][A-Z0-9_]*)\s*=(?!=)", "#", "indent", accessors=r"^\s*attr_(?:reader|writer|accessor)\s+(?P<n>.*)"),
    "php": Language((".php",), rf"^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface|trait|enum)\s+{NAME}(?:\s+extends\s+\\?(?:\w+\\)*(?P<up>[A-Z]\w*))?", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{NAME}", r"^\s*use\s+(?:function\s+|const\s+)?\\?(?P<n>[\w\\]+)(?:\s+as\s+\w+)?\s*;", r"^\s*(?:(?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?(?P<n>[A-Z]\w*)\s*=", fields=r"^\s*(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w|\\]+\s+)?\$(?P<n>\w+)\s*(?:=|;)"),
    "csharp": Language((".cs",), rf"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*(?:class|interface|struct|enum|record)\s+{NAME}(?:<[^>]*>)?(?:\s*:\s*(?P<up>[A-Z]\w*))?", rf"^\s*(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract|extern|new)\s+)+[\w<>\[\],.?]+(?:\s*<[^>]*>)?\s+{NAME}\s*(?:<[^>]*>)?\(", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?P<n>[\w.]+)\s*;", fields=rf"^\s*(?:(?:public|private|protected|internal|static|readonly|const|volatile|virtual|override|required)\s+)+[\w<>\[\],.?]+\s+{NAME}\s*(?:=|;|\{{\s*get\b)", constructor="<init>", typed=True),
    "c": Language((".c", ".cc", ".cpp", ".cxx", ".cu", ".h", ".hh", ".hpp", ".hxx"), rf"^\s*(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?|namespace)\s+{NAME}(?:\s*:\s*(?:public\s+|private\s+|protected\s+)?(?P<up>[A-Z]\w*))?\s*(?:\{{|$)", rf"^\s*(?!return\b|else\b|new\b|throw\b|delete\b|goto\b|case\b)[A-Za-z_][\w\s\*&:<>,~]*?[\s\*&:]~?{NAME}\s*\([^;]*\)\s*(?:const\s*|noexcept\s*|override\s*|final\s*)*(?:->\s*[\w:<>]+\s*)?(?::[^;{{]*)?\{{", r"^\s*#\s*include\s+[<\"](?P<n>[^>\"]+)", r"^\s*#\s*define\s+(?P<n>[A-Za-z_]\w*)", constructor="own", typed=True),
    "dart": Language((".dart",), rf"^\s*(?:(?:abstract|sealed|final|base|interface)\s+)*(?:class|mixin|extension|enum|typedef)\s+{NAME}(?:<[^>]*>)?(?:\s+extends\s+(?P<up>[A-Z]\w*))?", rf"^\s*(?:@\w+\s+)*(?:(?:static|external|late|final)\s+)*(?:[A-Z]\w*(?:<[^()]*>)?\??|void|int|double|bool|num|dynamic|var)\s+(?:get\s+)?{NAME}\s*(?:\([^;]*\)\s*(?:async\*?\s*|sync\*\s*)?)?(?:\{{|=>)", r"^\s*(?:import|export|part)\s+['\"](?P<n>[^'\"]+)", r"^(?:const|final)\s+(?:[\w<>?]+\s+)?(?P<n>\w+)\s*=", constructor="own", typed=True),
    "proto": Language((".proto",), rf"^\s*(?:service|message|enum)\s+{NAME}", rf"^\s*rpc\s+{NAME}", r"^\s*import\s+\"(?P<n>[^\"]+)"),
}
BY_EXTENSION = {e: k for k, lang in LANGUAGES.items() for e in lang.extensions} | {".py": "python", ".svelte": "svelte", ".vb": "vb"}


def register(name: str, language: Language) -> None:
    """UD1: add a language, or replace one; its files are read and scanned from then on."""
    LANGUAGES[name] = language
    BY_EXTENSION.update(dict.fromkeys(language.extensions, name))



def language_of(path: str) -> str | None:
    return BY_EXTENSION.get("." + path.rsplit(".", 1)[-1]) if "." in path else None


def without_comment(line: str, mark: str) -> str:
    """The line up to a comment mark that isn't in a string."""
    quote, k = "", 0
    while k < len(line):
        c = line[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif line.startswith(mark, k):
            return line[:k]
        k += 1
    return line


class Rows(list):
    """Nodes and edges of one file, in the order in which they are found."""

    def node(self, id_: str, type_: str, name: str, line: int, end: int, **more) -> None:
        more = {"signature": "", "docstring": "", "token_count": (end - line + 1) * 10} | more
        self.append(("node", len(self), id_, type_, name, line, end, None, None, None, *(more.get(k) for k in DETAILS)))

    def edge(self, source: str, target: str, relation: str, line: int | None) -> None:
        self.append(("edge", len(self), None, None, None, line, None, source, target, relation, *[None] * len(DETAILS)))

    def close(self, at: int, end: int) -> None:
        """The last line of a node, once it is known."""
        row = self[at]
        self[at] = (*row[:6], end, *row[7:-1], (end - row[5] + 1) * 10)


def python_rows(path: str, text: str) -> Rows:
    """A file that doesn't parse gives nothing, not even its own node. Calls in a nested function count for the outer one too."""
    out, root = Rows(), f"FILE:{path}"
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    out.node(root, "File", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, token_count=len(text) // 4)
    imported: dict[str, str] = {}  # a name in this file: what it stands for

    def full(name: str) -> str:
        first, dot, rest = name.partition(".")
        return imported.get(first, first) + dot + rest

    def calls(x: ast.AST, own: str) -> None:
        for c in ast.walk(x):
            if isinstance(c, ast.Call) and (name := dotted(c.func)):
                out.edge(own, f"REF:{full(name)}", "CALLS", c.lineno)

    def decorators(x: ast.AST, own: str) -> None:
        for d in x.decorator_list:
            if name := dotted(d.func if isinstance(d, ast.Call) else d):
                out.edge(own, f"REF:{full(name)}", "CALLS", d.lineno)

    def visit(body: list, scope: str, in_class: bool) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{scope}::{x.name}"
                out.node(own, "Method" if in_class else "Function", x.name, x.lineno, x.end_lineno, **details.python(x))
                out.edge(scope, own, "DEFINES", None)
                decorators(x, own)
                for part in x.body:
                    calls(part, own)
                visit(x.body, own, False)
            elif isinstance(x, ast.ClassDef):
                own = f"{scope}::{x.name}"
                out.node(own, "Class", x.name, x.lineno, x.end_lineno, docstring=ast.get_docstring(x) or "")
                out.edge(scope, own, "DEFINES", None)
                decorators(x, own)
                for b in x.bases:
                    if name := dotted(b):
                        out.edge(own, f"REF:{full(name)}", "INHERITS", x.lineno)
                visit(x.body, own, True)
            elif isinstance(x, ast.Import):
                for a in x.names:
                    if a.asname:
                        imported[a.asname] = a.name
                    out.edge(scope, f"MODULE:{a.name}", "IMPORTS", x.lineno)
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    whole = f"{x.module}.{a.name}" if x.module else a.name
                    imported[a.asname or a.name] = whole
                    out.edge(scope, f"MODULE:{whole}", "IMPORTS", x.lineno)
            elif isinstance(x, ast.Assign) and not scope.count("::"):
                for t in x.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        out.node(f"{scope}::{t.id}", "Constant", t.id, x.lineno, x.end_lineno, value=details.short(ast.unparse(x.value), 200))
                        out.edge(scope, f"{scope}::{t.id}", "DEFINES", None)
            elif isinstance(x, (ast.If, ast.Try)):
                visit([*x.body, *x.orelse], scope, in_class)

    visit(tree.body, root, False)
    return out


def dotted(x: ast.AST) -> str | None:
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute):
        inner = dotted(x.value)
        return f"{inner}.{x.attr}" if inner else None
    return None


VARIANT = re.compile(r"^\s*([A-Z]\w*)\s*(?:[({,=]|$)")
LITERAL = re.compile(r"\b([A-Z]\w*)\s*\{")
RPC = re.compile(r"\brpc\s+\w+\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)")
# Names, signatures and descriptions of set-up calls (patterns with groups; %s: the groups, or the given characters of a name replaced).
SET_UP = [
    (re.compile(r"\b(\w+)\.interceptors\.(request|response)\.use\s*\("), "{0}_{1}_interceptor", "{0}.interceptors.{1}.use(...)", "Configures {1} interceptor for {0}"),
    (re.compile(r"\b(app|router|server)\.use\s*\(\s*['\"]?([^'\",)\s(]+)"), "middleware_{1}", "{0}.use({1})", "Registers middleware: {1}"),
    (re.compile(r"\b(\w+)\.on\(\s*['\"]([^'\"]+)['\"]"), "{0}_on_{1}", "{0}.on('{1}', ...)", "Handles '{1}' event on {0}"),
]


def set_up(line: str) -> tuple[str, str, str] | None:
    """Name, signature and description of the interceptor, middleware or event handler that a line registers."""
    for pattern, *texts in SET_UP:
        if m := pattern.search(line):
            name, signature, told = (t.format(*m.groups()) for t in texts)
            return re.sub(r"\W+", "_", name).rstrip("_"), signature, told
    return None


def block_end(lines: list[str], k: int) -> int:
    """How many lines after line k the block ends that begins in it: 0 if none begins there, to the end of the file if it stays open."""
    depth = 0
    for n in range(k, len(lines)):
        depth += lines[n].count("{") - lines[n].count("}")
        if depth <= 0:
            return n - k
    return len(lines) - 1 - k


@dataclass
class Scope:
    depth: int  # (or indent) at which it began
    id: str
    type: str
    at: int | None  # the place of its node
    trait: str | None = None
    is_enum: bool = False
    open: bool = True  # its body has begun


def whole_declaration(lines: list[str], k: int, lang: Language) -> str:
    """Line k and those after it up to where the body begins, on one line, if it may be a declaration whose brace comes later; else the line alone."""
    line = without_comment(lines[k], lang.comment)
    if not lang.typed or "(" not in line or "{" in line or line.rstrip().endswith((";", "}", "=>")):
        return line
    parts = [line.rstrip()]
    for after in lines[k + 1 : k + AHEAD]:
        after = without_comment(after, lang.comment).strip()
        if after.startswith("{") or not parts[-1].endswith(")"):
            parts.append(after)
        else:
            return line
        if "{" in after:
            return " ".join(parts)
        if ";" in after:
            return line
    return line


def scanned_rows(path: str, text: str, lang: Language, first_line: int = 1) -> Rows:
    out, root = Rows(), f"FILE:{path}"
    lines = text.split("\n")
    out.node(root, "File", path.rsplit("/", 1)[-1], 1, len(lines), token_count=len(text) // 4)
    named = next((k for k, v in LANGUAGES.items() if v is lang), "")
    quiet = named not in ALWAYS and any(m in x for x in lines[:30] for m in GENERATED)
    classes, functions, imports, constants, fields, accessors, groups = (re.compile(p) for p in (lang.classes, lang.functions, lang.imports, lang.constants, lang.fields, lang.accessors, lang.group))
    keywords = KEYWORDS_OF.get(named, ANY_KEYWORD)
    is_rust, is_ts, is_proto = (lang is LANGUAGES[x] for x in ("rust", "typescript", "proto"))
    scopes = [Scope(-1, root, "File", None)]
    depth, last, in_group, known = 0, first_line, False, set()

    def leave() -> None:
        at = scopes.pop().at
        if at is not None:
            out.close(at, last)

    def constant(scope: str, name: str, number: int, k: int, value: str | None) -> None:
        if name != "_" and f"{scope}::{name}" not in known:
            known.add(f"{scope}::{name}")
            out.node(f"{scope}::{name}", "Constant", name, number, number, docstring=details.comment_above(lines, k), value=value)
            out.edge(scope, f"{scope}::{name}", "DEFINES", None)

    for k, raw in enumerate(lines):
        line, number = without_comment(raw, lang.comment), k + first_line
        if not line.strip():
            continue
        level = len(line) - len(line.lstrip()) if lang.blocks == "indent" else depth
        declared = whole_declaration(lines, k, lang)
        if not scopes[-1].open and (classes.match(line) or functions.match(declared)):
            leave()
        while len(scopes) > 1 and scopes[-1].open and level <= scopes[-1].depth and not (lang.blocks == "indent" and line.strip() == "end" and level == scopes[-1].depth):
            leave()
        top, last = scopes[-1], number
        scope, kind = top.id, top.type
        made, at, found, declares = None, len(out), {}, None
        inside = [s.id.rsplit("::", 1)[-1] for s in scopes if s.type == "Class"]
        if in_group:
            in_group = line.strip() != ")"
            if in_group and depth == 0 and (m := re.match(r"\s*([A-Za-z_]\w*)", line)):
                constant(scope, m[1], number, k, (line.partition("=")[2].strip() or None))
            continue
        if groups.match(line):
            in_group = True
            continue
        if is_ts and (shown := set_up(line)):
            ends = number + block_end(lines, k)
            out.node(f"{root}::{shown[0]}", "Configuration", shown[0], number, ends, signature=shown[1], docstring=details.comment_above(lines, k) or shown[2], token_count=max((ends - number + 1) * 10, 50 if "interceptors" in shown[1] else 30))
            out.edge(root, f"{root}::{shown[0]}", "DEFINES", None)
        elif (m := imports.match(line)) and (not inside or named != "php"):
            out.edge(root, f"MODULE:{m['n']}", "IMPORTS", number)
        elif m := classes.match(line):
            found = m.groupdict()
            name = found.get("n") or found.get("n2") or found.get("impl")
            made = f"{scope}::{name}"
            at = at if not found.get("impl") else None
            if not found.get("impl"):
                out.node(made, "Class", name, number, number, docstring=details.comment_above(lines, k))
                out.edge(scope, made, "DEFINES", None)
            if found.get("up"):
                out.edge(made, f"REF:{found['up']}", "INHERITS", number)
            kind = "Class"
        elif (m := functions.match(declared)) and (name := next(v for g, v in m.groupdict().items() if g.startswith("n") and v)) not in keywords:
            if owner := m.groupdict().get("owner"):
                scope, kind = f"{root}::{owner}", "Class"
            made = f"{scope}::{name}"
            kind = "Method" if kind == "Class" and not is_proto else "Function"
            more = details.rust(name, details.head(lines, k)) if is_rust else details.typescript(name, details.head(lines, k)) if is_ts else {}
            if is_proto and (m := RPC.search(line)):
                more = {"signature": f"rpc {name}({m[1]}) returns ({m[2]})"}
            out.node(made, kind, name, number, number, docstring=details.comment_above(lines, k), trait_impl=top.trait if kind == "Method" else None, **more)
            out.edge(scope, made, "DEFINES", None)
            if is_proto and m:
                out.edge(made, f"REF:{m[1]}", "CALLS", None)
                out.edge(made, f"REF:{m[2]}", "CALLS", None)
        elif lang.constructor and kind == "Class" and depth == top.depth + 1 and (m := re.match(rf"^\s*(?:(?:public|private|protected|internal|const|factory|explicit|inline)\s+)*({re.escape(inside[-1])}(?:\.\w+)?)\s*\(", line)) and not (named == "c" and "{" not in declared):
            name = lang.constructor if lang.constructor != "own" else m[1]
            made, kind, declares = f"{scope}::{name}", "Method", m[1].rsplit(".", 1)[-1]
            out.node(made, kind, name, number, number, docstring=details.comment_above(lines, k))
            out.edge(scope, made, "DEFINES", None)
        elif m := constants.match(line):
            constant(scope, m["n"], number, k, (line.partition("=")[2] or line[m.end() :]).strip().rstrip(";") or None)
        elif kind == "Class" and depth == top.depth + 1 and (m := fields.match(line)):
            constant(scope, m["n"], number, k, line.partition("=")[2].strip().rstrip(";") or None)
        elif m := accessors.match(line):
            for name in re.findall(r":([a-z_]\w*)", m["n"]):
                out.node(f"{scope}::{name}", "Method", name, number, number)
                out.edge(scope, f"{scope}::{name}", "DEFINES", None)
            continue
        elif top.is_enum and depth == top.depth + 1 and (m := VARIANT.match(line)):
            out.node(f"{scope}::{m[1]}", "Function", m[1], number, number, signature=f"{scope.split('::')[-1]}::{m[1]}", docstring=details.comment_above(lines, k))
            out.edge(scope, f"{scope}::{m[1]}", "DEFINES", None)
            declares = m[1]
        if not quiet and not is_proto and not imports.match(line):
            own = made.rsplit("::", 1)[-1] if made else None
            if lang.typed and not made and (m := TYPED.match(line)) and m["first"] not in keywords and "=" not in line[: m.end()] and kind in ("Class", "File"):
                declares = m["n"]  # a declaration without a body, or of a kind that gives no node
            first_call = True
            body = "" if lang.typed and found else line[line.find("{") :] if named == "c" and declares and made and "{" in line else line
            for c in CALL.finditer(body):
                callee = re.sub(r"^this->", "this.", c[1].replace("?.", "."))
                parts = re.split(r"::|\.|->", callee)
                if first_call and declares and parts[-1] == declares:
                    first_call = False
                    continue
                if parts[-1] not in keywords and (parts[0] not in keywords or len(parts) > 1 and parts[0] in SELF_LIKE) and parts[-1] != own:
                    out.edge(made or scope, f"REF:{callee}", "CALLS", number)
                if is_rust and len(parts) > 1 and parts[-2][0].isupper() and (parts[-1] in details.CONSTRUCTORS or parts[-1].startswith(("with_", "from_"))):
                    out.edge(made or scope, f"REF:{parts[-2]}", "INSTANTIATES", number)
            if is_rust and not found and not made:
                for c in LITERAL.finditer(line):
                    if c[1] not in details.NOT_LITERALS and not line.lstrip().startswith("impl"):
                        out.edge(scope, f"REF:{c[1]}", "INSTANTIATES", number)
        opens, closes = line.count("{"), line.count("}")
        if not top.open and not made:  # a declaration that goes on over several lines
            top.open = opens > 0
            if not opens and line.rstrip().endswith(";"):
                leave()
        if made and (lang.blocks == "indent" or opens > closes or not line.rstrip().endswith((";", "}"))):
            scopes.append(Scope(level, made, kind, at, found.get("up") if found.get("impl") else None, is_rust and " enum " in f" {line}", lang.blocks == "indent" or opens > 0))
        depth = max(0, depth + opens - closes)
    while len(scopes) > 1:
        leave()
    return out


def file_row(out: Rows, path: str, text: str) -> None:
    out.node(f"FILE:{path}", "File", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, token_count=len(text) // 4)


def svelte_rows(path: str, text: str) -> Rows:
    """The script blocks of a component, with line numbers of the whole file."""
    out = Rows()
    file_row(out, path, text)
    for m in re.finditer(r"<script[^>]*>\n?(.*?)</script>", text, re.S):
        for row in scanned_rows(path, m[1], LANGUAGES["typescript"], text.count("\n", 0, m.start(1)) + 1):
            if row[3] != "File":
                out.append((row[0], len(out), *row[2:]))
    return out


def rows_of(path: str, text: str) -> Rows:
    lang = language_of(path)
    if lang == "python":
        return python_rows(path, text)
    if lang == "svelte":
        return svelte_rows(path, text)
    if lang == "vb":  # the file alone
        out = Rows()
        file_row(out, path, text)
        return out
    return scanned_rows(path, text, LANGUAGES[lang]) if lang else Rows()


def extract(files: DataFrame) -> DataFrame:
    """Nodes and edges (SCHEMA, with path) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"].tolist(), batch["content"].tolist()):
                rows = rows_of(path, content or "")
                if rows:
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                    yield out.assign(path=path).astype({"lineno": "Int32", "end_lineno": "Int32", "token_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA + ", path string")
