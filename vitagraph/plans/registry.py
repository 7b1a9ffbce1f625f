"""The named graph queries, with their arguments coerced from text."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..graph import Graph
from ..operators import answers as A
from ..operators import search as S
from ..operators import traverse as T


def integer(value: Any, default: int) -> int:
    """A finite positive number rounded down, else the default."""
    try:
        n = float(value)
    except (TypeError, ValueError):
        return default
    return math.floor(n) if math.isfinite(n) and n > 0 else default


def text(value: Any) -> str | None:
    return value if isinstance(value, str) and value != "" else None


def boolean(value: Any) -> bool:
    return value is True or value in ("true", "1")


@dataclass(frozen=True)
class Query:
    name: str
    description: str
    run: Callable[[Graph, dict[str, Any]], Any]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)

    def input_schema(self) -> dict:
        properties = {a: {"type": self.kinds.get(a, "string")} for a in (*self.required, *self.optional)}
        return {"type": "object", "properties": properties, "required": list(self.required)}

    def __call__(self, g: Graph, args: dict[str, Any] | None = None) -> Any:
        args = args or {}
        lacking = [a for a in self.required if text(args.get(a)) is None]
        if lacking:
            raise ValueError(f"{self.name} needs {', '.join(lacking)}")
        return self.run(g, args)


def _landscape(g: Graph, a: dict) -> DataFrame:
    return A.evidence_landscape(g, a["topic"])


QUERIES: dict[str, Query] = {
    q.name: q
    for q in (
        Query("what_affects", "Claims about what affects an outcome or disease.", lambda g, a: A.what_affects(g, a["object"], boolean(a.get("protective"))), ("object",), ("protective",), {"protective": "boolean"}),
        Query("high_certainty_about", "High-certainty claims with a node as subject or object.", lambda g, a: A.high_certainty_about(g, a["node"]), ("node",)),
        Query("conflicts", "Pairs of claims that contradict each other.", lambda g, a: A.conflicts(g)),
        Query("gaps", "Claims that are not settled yet.", lambda g, a: A.gaps(g)),
        Query("knowledge_gaps", "Open gaps with their questions and concerns.", lambda g, a: A.knowledge_gaps(g, text(a.get("topic"))), (), ("topic",)),
        Query("for_population", "Claims scoped to a population.", lambda g, a: A.for_population(g, a["population"]), ("population",)),
        Query("neighbourhood", "Every claim that touches a node.", lambda g, a: A.neighbourhood(g, a["node"]), ("node",)),
        Query("comparative", "Claims with a comparator.", lambda g, a: A.comparative(g)),
        Query("evidence_landscape", "Direct, indirect, conflicting and weak evidence on a topic.", _landscape, ("topic",)),
        Query("recommendations", "Recommendations by population and issuer.", lambda g, a: A.recommendations(g, text(a.get("population")), text(a.get("issuer"))), (), ("population", "issuer")),
        Query("path", "Shortest connecting path between two nodes.", lambda g, a: T.shortest_path(g, a["from"], a["to"], integer(a.get("max_hops"), 6)), ("from", "to"), ("max_hops",), {"max_hops": "integer"}),
        Query("search", "Text search over nodes and claims.", lambda g, a: S.search(g, a["q"], integer(a.get("k"), 5), text(a.get("owner"))), ("q",), ("k", "owner"), {"k": "integer"}),
        Query("get_node", "One node by id.", lambda g, a: A.get_node(g, a["id"]), ("id",)),
        Query("node_detail", "A node's claims and neighbours.", lambda g, a: {"node": A.get_node(g, a["id"]), "claims": A.node_claims(g, a["id"]), "neighbours": A.node_neighbours(g, a["id"])}, ("id",)),
        Query("list_nodes", "Nodes by type, domain and text.", lambda g, a: A.list_nodes(g, text(a.get("type")), text(a.get("domain")), text(a.get("q"))), (), ("type", "domain", "q")),
        Query("list_claims", "Claims by type, status, certainty, subject and object.", lambda g, a: A.list_claims(g, **{k: text(a.get(k)) for k in ("type", "status", "certainty", "subject", "object")}), (), ("type", "status", "certainty", "subject", "object")),
    )
}


def run(name: str, g: Graph, args: dict[str, Any] | None = None) -> Any:
    """Run a query by name; an unknown name says what there is."""
    if name not in QUERIES:
        raise KeyError(f"no query {name}; there are {', '.join(QUERIES)}")
    return QUERIES[name](g, args)
