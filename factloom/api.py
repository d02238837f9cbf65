"""Queries by function call, for programs and editors: each answers with plain rows, bounded by a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import graph as G
from factloom.operators import relational as R
from factloom.sources.facts import FactSet, MissingFacts, read_facts

#: Rows that an answer holds at most, unless the caller says otherwise.
LIMIT = 10_000


class Closed(ValueError):
    """The snapshot was closed."""


class Snapshot:
    """An open fact set (X5): find functions and symbols, call edges, call graphs, call chains, dataflow; and call hierarchies for editors."""

    def __init__(self, facts: FactSet, limit: int = LIMIT):
        self._facts: FactSet | None = facts
        self.limit = limit

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: list[str] | None = None, limit: int = LIMIT) -> Snapshot:
        """Reads a folder of facts; what is missing is said at once."""
        return cls(read_facts(spark, path, names), limit)

    def close(self) -> None:
        self._facts = None

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def facts(self) -> FactSet:
        if self._facts is None:
            raise Closed("the snapshot is closed")
        return self._facts

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.limit(self.limit).collect()]

    def find_functions(self, name: str | None = None, file: str | None = None, line: int | None = None) -> list[dict]:
        """Functions by name, or at a line of a file; definitions and narrow ones first."""
        if name is None and (file is None or line is None):
            raise ValueError("a name, or a file and a line")
        return self._rows(R.functions_by_name(self.facts, name, file) if name is not None else R.functions_at(self.facts, file, line))

    def find_symbols(self, file: str, line: int, col: int) -> list[dict]:
        return self._rows(R.symbols_at(self.facts, file, line, col))

    def call_edges(self, from_: str | None = None, to: str | None = None, file: str | None = None, exclude_deps: bool = False) -> list[dict]:
        return self._rows(R.calls(self.facts, from_, to, file, exclude_deps))

    def call_graph(self, target: str, depth: int = 3, down: bool = True) -> dict:
        """Nodes and edges around a function given by name or FILE:LINE, and whether the depth cut something off."""
        found = G.call_graph(self.facts, R.resolve_function(self.facts, target), depth, down)
        return {"nodes": self._rows(found.nodes.orderBy("depth", "id")), "edges": self._rows(found.edges), "truncated": bool(found.truncated.first().truncated)}

    def call_chains(self, start: str, end: str, depth: int = 8, limit: int = 100) -> dict:
        edges = self.facts["call_edges"].selectExpr("id", "caller_fn_id a", "callee_fn_id b")
        paths, cut = G.chains(edges, R.resolve_function(self.facts, start), R.resolve_function(self.facts, end), depth, limit)
        return {"chains": self._rows(paths), "truncated": bool(cut.first().truncated)}

    def dataflow(self, name: str, depth: int = 3, down: bool = True) -> dict:
        """Flow nodes around the variables of a name."""
        starts = R.flow_nodes_of(self.facts, self.facts["variables"].where(f"name = '{name}'" if "'" not in name else "false"))
        found = G.dataflow_graph(self.facts, starts, depth, down)
        labels = R.node_labels(self.facts)
        return {"nodes": self._rows(found.nodes.join(labels, "id", "left").orderBy("depth", "id")), "edges": self._rows(found.edges), "truncated": bool(found.truncated.first().truncated)}

    # A call hierarchy, as editors ask for it.

    def prepare_call_hierarchy(self, file: str, line: int) -> list[dict]:
        """The function at a place, the innermost definition first."""
        return self.find_functions(file=file, line=line)[:1]

    def _peers(self, fn_id: int, incoming: bool) -> list[dict]:
        rows = R.editor_calls(self.facts, fn_id, incoming)
        named = rows.join(self.facts["functions"].selectExpr("id peer", "name"), "peer")
        by: dict[int, dict] = {}
        for r in named.orderBy("peer", "line", "col", "id").limit(self.limit).collect():
            by.setdefault(r.peer, {"id": r.peer, "name": r["name"], "places": []})
            if r.line is not None and (r.line, r.col) not in by[r.peer]["places"]:
                by[r.peer]["places"].append((r.line, r.col))
        return list(by.values())

    def incoming_calls(self, fn_id: int) -> list[dict]:
        """Callers of a function, each with the places of its calls."""
        return self._peers(fn_id, True)

    def outgoing_calls(self, fn_id: int) -> list[dict]:
        """Callees of a function, each with the places of the calls."""
        return self._peers(fn_id, False)


__all__ = ["Closed", "LIMIT", "MissingFacts", "Snapshot"]
