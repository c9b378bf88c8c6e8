"""The requests of the web service as checked functions: what a page asks for, answered from a catalog of graphs.

``handle`` takes a method, a path and its parameters and gives a status and a body of plain values; any web server can
be put before it. Unknown graphs and nodes are 404, parameters out of bounds 422.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.plans.pipeline import Catalog

# Bounds of the parameters.
HOPS, OVERVIEW, OVERVIEW_DEFAULT = (1, 2), (50, 5000), 2000


class Missing(Exception):
    """What is asked for isn't there."""


class Refused(Exception):
    """A parameter is no number or out of bounds."""


def whole(params: dict, name: str, default: int, bounds: tuple[int, int]) -> int:
    """An integer parameter within its bounds."""
    try:
        value = int(params.get(name, default))
    except (TypeError, ValueError):
        raise Refused(f"{name} must be an integer") from None
    if not bounds[0] <= value <= bounds[1]:
        raise Refused(f"{name} must be between {bounds[0]} and {bounds[1]}")
    return value


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _graph(catalog: Catalog, name: str):
    if not catalog.has(name):
        raise Missing(f"no graph {name}")
    return catalog.get(name)


def stats(catalog: Catalog, name: str) -> dict:
    n, e = _graph(catalog, name)
    kinds = n.groupBy(F.coalesce("entity_type", F.lit("Concept")).alias("k")).count()
    return G.stats(n, e).first().asDict() | {
        "entity_type_distribution": {r["k"]: r["count"] for r in kinds.collect()},
        "relation_type_distribution": {r["k"]: r["count"] for r in e.groupBy(F.coalesce("relation", F.lit("unknown")).alias("k")).count().collect()},
        "type_colors": G.TYPE_COLORS}


def search(catalog: Catalog, name: str, query: str = "") -> list[dict]:
    return _rows(G.search(_graph(catalog, name)[0], query))


def _node(n, entity: str) -> dict:
    got = n.where(F.col("id") == entity).first()
    if got is None:
        raise Missing(f"no entity {entity}")
    return got.asDict()


def detail(catalog: Catalog, name: str, entity: str) -> dict:
    n, e = _graph(catalog, name)
    node = _node(n, entity)
    rows = _rows(G.entity_detail(n, e, entity))
    return {"entity": node, "color": G.TYPE_COLORS.get(node["entity_type"] or "Concept", "#374151"),
            "out_relations": [r for r in rows if r["direction"] == "out"], "in_relations": [r for r in rows if r["direction"] == "in"]}


def subgraph(catalog: Catalog, name: str, entity: str, params: dict) -> dict:
    hops = whole(params, "hops", 1, HOPS)
    n, e = _graph(catalog, name)
    _node(n, entity)
    return {"nodes": _rows(G.subgraph(n, e, entity, hops)), "edges": _rows(G.subgraph_edges(e, entity, hops)), "center": entity}


def overview(catalog: Catalog, name: str, params: dict) -> dict:
    limit = whole(params, "limit", OVERVIEW_DEFAULT, OVERVIEW)
    n, e = _graph(catalog, name)
    return {"nodes": _rows(G.overview(n, e, limit)), "edges": _rows(G.overview_edges(n, e, limit)), "type_colors": G.TYPE_COLORS}


def handle(catalog: Catalog, method: str, path: str, params: dict | None = None, docs=None) -> tuple[int, object]:
    """(status, body) of a request. ``docs``: the documents (doc_id, text) of a POST that brings any."""
    params = params or {}
    part = [unquote(x) for x in path.strip("/").split("/")]
    if part[:2] != ["api", "graphs"]:
        return 404, {"detail": "no such path"}
    part = part[2:]
    try:
        if not part:
            if method == "GET":
                return 200, _rows(catalog.list())
            if method == "POST":
                name = params.get("name") or ""
                if not name or "/" in name:
                    raise Refused("name is needed")
                catalog.create(name, params.get("description", ""), docs)
                return 200, catalog.meta(name)
        elif len(part) == 1 and method in ("GET", "DELETE"):
            meta = _meta(catalog, part[0])
            if method == "GET":
                return 200, meta
            catalog.delete(part[0])
            return 200, {"deleted": part[0]}
        elif part[1:] == ["upload"] and method == "POST":
            _meta(catalog, part[0])
            if docs is None:
                raise Refused("documents are needed")
            catalog.add(part[0], docs)
            return 200, {"queued": docs.count()}
        elif method == "GET":
            rest = "/".join(part[2:])
            if part[1] == "stats" and not rest:
                return 200, stats(catalog, part[0])
            if part[1] == "search" and not rest:
                return 200, search(catalog, part[0], str(params.get("q", "")))
            if part[1] == "overview" and not rest:
                return 200, overview(catalog, part[0], params)
            if part[1] == "entity" and rest:
                return 200, detail(catalog, part[0], rest)
            if part[1] == "subgraph" and rest:
                return 200, subgraph(catalog, part[0], rest, params)
        return 404, {"detail": "no such path"}
    except Missing as x:
        return 404, {"detail": str(x)}
    except Refused as x:
        return 422, {"detail": str(x)}


def _meta(catalog: Catalog, name: str) -> dict:
    try:
        return catalog.meta(name)
    except KeyError:
        raise Missing(f"no graph {name}") from None
