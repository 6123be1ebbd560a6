"""The tools as JSON routes: a route and its parameters give a status and a JSON text. A web server of any kind can stand in front."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from loomgraph import sinks
from loomgraph.engine import REPORT_LINES, Engine


def words(text: str) -> list[str]:
    return text.split()


def yes(text: str) -> bool:
    return text.lower() in ("1", "true", "yes")


def of(*choices: str) -> Callable[[str], str]:
    def checked(text: str) -> str:
        if text not in choices:
            raise ValueError(f"{text!r} is none of {', '.join(choices)}")
        return text

    return checked


WAYS = of("forward", "backward")
#: For each route the engine's method, the parameters that must be there and those that may, with the types of their texts.
ROUTES: dict[str, tuple[str, dict[str, Callable], dict[str, Callable]]] = {
    "/api/health": ("health", {}, {}),
    "/api/status": ("status", {}, {}),
    "/api/search": ("search", {"terms": words}, {"limit": int, "lang": str, "crate": str, "symbol_type": str, "exclude_tests": yes}),
    "/api/callers": ("callers", {"name": str}, {"limit": int}),
    "/api/callees": ("callees", {"name": str}, {"limit": int}),
    "/api/alternatives": ("alternatives", {"name": str}, {"limit": int}),
    "/api/context": ("context", {"node_id": str}, {"brief": yes, "full": yes, "depth": int, "expand": yes, "head_lines": int, "max_output_tokens": int, "callee_budget": int}),
    "/api/quick": ("quick", {"name": str}, {"full": yes, "brief": yes}),
    "/api/flow": ("flow", {"name": str}, {"direction": WAYS, "depth": int, "target": str}),
    "/api/path": ("path", {"start": str, "end": str}, {"direction": WAYS, "depth": int}),
    "/api/expand": ("expand", {"node_id": str}, {"budget": int, "depth": int}),
    "/api/structure": ("structure", {"file": str}, {}),
    "/api/flatten": ("flatten", {"class_id": str}, {}),
    "/api/impls": ("impls", {"method": str}, {"trait": str}),
    "/api/resolve": ("resolve_id", {"query": str}, {}),
    "/api/source": ("source", {"path": str}, {"line": int}),
    "/api/examples": ("examples", {}, {}),
    "/api/churn": ("churn", {}, {"mode": of("symbols", "files", "co-change"), "limit": int, "time_range": str, "path": str, "exclude_generated": yes}),
    "/api/evolution": ("evolution", {"name": str}, {"time_range": str, "crate": str}),
    "/api/changes": ("changes", {}, {"limit": int, "time_range": str, "path": str, "show_callers": yes}),
    "/api/change-totals": ("change_totals", {}, {"time_range": str, "path": str}),
    "/api/endpoints": ("cross_lang", {}, {"mode": of("list", "stats"), "tag": str}),
}


def respond(engine: Engine, route: str, parameters: Mapping[str, str]) -> tuple[int, str]:
    """The status and JSON text of a request: 404 for no such route, 400 for parameters that are missing or wrong."""
    if route not in ROUTES:
        return 404, json.dumps({"error": f"no route {route}"})
    method, needed, optional = ROUTES[route]
    if missing := [p for p in needed if not parameters.get(p)]:
        return 400, json.dumps({"error": f"missing: {', '.join(missing)}"})
    try:
        values = {p: read(parameters[p]) for p, read in {**needed, **optional}.items() if parameters.get(p)}
        rows: DataFrame = getattr(engine, method)(**values)
    except ValueError as e:
        return 400, json.dumps({"error": str(e)})
    shown = sinks.as_json(rows).limit(REPORT_LINES.get(method, 500)).collect()
    return 200, '{"rows": [' + ", ".join(r["json"] for r in shown) + "]}"
