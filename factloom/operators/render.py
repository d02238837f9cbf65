"""Text forms of results: indented text, JSON, Graphviz, Mermaid. Results of bounded queries only are brought to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from factloom.operators.graph import QueryGraph

MERMAID = {"&": "&amp;", '"': "&quot;", "<": "&lt;", ">": "&gt;", "|": "&#124;", "#": "#35;"}


class Drawing:
    """A result graph on the driver, in a fixed order; at most limit nodes and edges."""

    def __init__(self, graph: QueryGraph, labels: DataFrame, limit: int = 100_000):
        named = graph.nodes.join(labels.select("id", "label"), "id", "left")
        self.nodes = [(r.id, r.depth, r.label or f"node{r.id}") for r in named.orderBy("depth", "id").limit(limit).collect()]
        columns = [c for c in ("resolution", "kind") if c in graph.edges.columns]
        rows = graph.edges.select("a", "b", *columns[:1]).distinct().orderBy("a", "b", *columns[:1]).limit(limit).collect()
        self.edges = [(r[0], r[1], r[2] if len(r) > 2 else "") for r in rows]
        self.truncated = bool(graph.truncated.first()[0])
        self.label = {n: text for n, _, text in self.nodes}

    @staticmethod
    def name(node: int) -> str:
        """An identifier that Graphviz and Mermaid take; leaves with negative ids get a letter of their own."""
        return f"u{-node}" if node < 0 else f"n{node}"

    def text(self, title: str) -> str:
        """A tree from each root; what was shown before is only named again."""
        below: dict[int, list] = {}
        for a, b, kind in self.edges:
            below.setdefault(a, []).append((b, kind))
        lines, seen = [title], set()
        stack = [(n, 0, None) for n, depth, _ in reversed(self.nodes) if depth == 0]
        while stack:
            node, level, kind = stack.pop()
            again = node in seen and kind is not None
            mark = "* " if kind is None else f"-{kind}-> "
            lines.append("  " * level + mark + self.label.get(node, f"node{node}") + (" (see above)" if again else ""))
            if not again:
                seen.add(node)
                stack += [(b, level + 1, k) for b, k in reversed(below.get(node, []))]
        return "\n".join([*lines, *["(truncated; increase the depth to see more)"] * self.truncated, f"{len(self.nodes)} nodes, {len(self.edges)} edges"])

    def json(self) -> str:
        nodes = [{"id": n, "depth": d, "label": text} for n, d, text in self.nodes]
        return json.dumps({"nodes": nodes, "edges": [{"from": a, "to": b, "label": k} for a, b, k in self.edges], "truncated": self.truncated}, ensure_ascii=False)

    def graphviz(self, title: str) -> str:
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"digraph {quote(title)} {{", '  rankdir="TB";', "  node [shape=box];"]
        lines += [f"  {self.name(n)} [label={quote(text)}];" for n, _, text in self.nodes]
        lines += [f"  {self.name(a)} -> {self.name(b)} [label={quote(k)}];" for a, b, k in self.edges]
        return "\n".join([*lines, "}"])

    def mermaid(self, title: str) -> str:
        safe = lambda s: "".join(MERMAID.get(c, c) for c in s)
        lines = ["flowchart TD", f"  %% {safe(title)}"] + [f'  {self.name(n)}["{safe(text)}"]' for n, _, text in self.nodes]
        return "\n".join(lines + [f'  {self.name(a)} -->|"{safe(k)}"| {self.name(b)}' for a, b, k in self.edges])


def chain_lines(chains: DataFrame, labels: DataFrame, limit: int = 10_000) -> list[str]:
    """One line a chain, shortest first."""
    rows = chains.limit(limit).collect()
    wanted = sorted({n for r in rows for n in r.nodes})
    names = {r.id: r.label for r in labels.where(labels.id.isin(wanted)).collect()} if wanted else {}
    return [" -> ".join(names.get(n, f"node{n}") for n in r.nodes) for r in rows]


def slice_text(nodes: DataFrame, labels: DataFrame, title: str, form: str = "text", limit: int = 10_000) -> str:
    """A value slice (id, side) as text or JSON: sources first, then what lies on both sides, then where values go."""
    named = nodes.join(labels.select("id", "label", "detail"), "id", "left").limit(limit + 1).collect()
    sides = ("up", "both", "down")
    rows = sorted((sides.index(r.side), r.id, r.label or f"node{r.id}", r.detail or "") for r in named[:limit])
    cut = len(named) > limit
    if form == "json":
        return json.dumps({"start": title, "nodes": [{"id": n, "side": sides[s], "label": text, "detail": d} for s, n, text, d in rows], "truncated": cut}, ensure_ascii=False)
    heads = ("comes from", "comes from and goes to", "goes to")
    lines = [f"slice of {title}"]
    for s, head in enumerate(heads):
        own = [r for r in rows if r[0] == s]
        lines += [f"{head}:"] * bool(own) + [f"  {text}" + (f" ({d})" if d else "") for _, _, text, d in own]
    return "\n".join([*lines, *["(truncated)"] * cut, f"{len(rows)} nodes"])


def sequence_text(scope: DataFrame, events: DataFrame, relations: DataFrame, form: str = "text", limit: int = 200) -> str:
    """The events of a scope by block and place, with how each relates to the others in it (K15); at most limit events."""
    rows = events.join(scope, "event", "left_semi").orderBy("block", "ordinal", "event").limit(limit + 1).collect()
    shown = [r.event for r in rows[:limit]]
    pairs = relations.where(relations.a.isin(shown) & relations.b.isin(shown)).orderBy("a", "b").collect() if shown else []
    cut = len(rows) > limit
    if form == "json":
        body = {"events": [{"event": r.event, "block": r.block, "ordinal": r.ordinal} for r in rows[:limit]], "relations": [{"a": p.a, "b": p.b, "relation": p.relation} for p in pairs], "truncated": cut}
        return json.dumps(body)
    lines = [f"block {r.block}.{r.ordinal}: event {r.event}" for r in rows[:limit]] + [f"{p.a} {p.relation} {p.b}" for p in pairs]
    return "\n".join([*lines, *["(truncated)"] * cut, f"{len(shown)} events"])
