"""Order of calls inside function bodies: control-flow graphs are small, so each is one group.

Relations: sequenced_before, guaranteed_before, may_precede, may_follow, may_both, exclusive, unordered, unknown.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = "sequenced_before guaranteed_before may_precede may_follow may_both exclusive unordered unknown".split()


#: Events of a graph that one row holds at most, and pairs that a worker holds at once, about.
SLICE, PAIRS = 256, 1 << 18
CODE = {r: i for i, r in enumerate(RELATIONS)}


def _fields(events: pa.ListScalar) -> list[np.ndarray]:
    """event, block, ordinal of a list of events."""
    return [events.values.field(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("event", "block", "ordinal")]


class Flow:
    """One graph: successor lists, what each block reaches by at least one edge, and what dominates it."""

    def __init__(self, edges: list[tuple[int, int]], entry: int = 0):
        self.next: dict[int, list[int]] = {}
        for a, b in edges:
            self.next.setdefault(a, []).append(b)
        self.entry = entry
        self._reach: dict[int, set[int]] = {}
        self._dominators: dict[int, set[int]] | None = None

    def reach(self, block: int) -> set[int]:
        if block not in self._reach:
            seen, stack = set(), list(self.next.get(block, ()))
            while stack:
                b = stack.pop()
                if b not in seen:
                    seen.add(b)
                    stack += self.next.get(b, ())
            self._reach[block] = seen
        return self._reach[block]

    def layout(self) -> list[int]:
        """Blocks in reverse postorder from the entry (Q27)."""
        out, seen = [], {self.entry}
        stack = [(self.entry, iter(sorted(set(self.next.get(self.entry, ())))))]
        while stack:
            block, rest = stack[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(sorted(set(self.next.get(b, ()))))))
                    break
            else:
                out.append(block)
                stack.pop()
        return out[::-1]

    def dominators(self) -> dict[int, set[int]]:
        """For each block that the entry reaches, all blocks on every path to it (Q26)."""
        if self._dominators is None:
            order = self.layout()
            before: dict[int, list[int]] = {b: [] for b in order}
            for a in order:
                for b in self.next.get(a, ()):
                    before[b].append(a)
            found: dict[int, set[int]] = {self.entry: {self.entry}}
            changed = True
            while changed:
                changed = False
                for b in order[1:]:
                    known = [found[a] for a in before[b] if a in found]
                    new = set.intersection(*known) | {b}
                    if found.get(b) != new:
                        found[b], changed = new, True
            self._dominators = found
        return self._dominators

    def relate(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        """How event a = (block, ordinal) relates to event b; equal ordinals of a block have no order (Q25)."""
        (block_a, at_a), (block_b, at_b) = a, b
        ahead, back = block_b in self.reach(block_a), block_a in self.reach(block_b)
        if block_a == block_b:
            return "may_both" if ahead else "sequenced_before" if at_a < at_b else "may_follow" if at_a > at_b else "unordered"
        if ahead and back:
            return "may_both"
        if ahead:
            return "guaranteed_before" if block_a in self.dominators().get(block_b, ()) else "may_precede"
        return "may_follow" if back else "exclusive"


def _packed(events: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: its edges and its events."""
    g = edges.groupBy("cfg_id").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    e = events.groupBy("cfg_id").agg(F.sort_array(F.collect_list(F.struct("event", "block", "ordinal"))).alias("events"))
    return e.join(g, "cfg_id", "left")


def event_relations(events: DataFrame, edges: DataFrame, unmodeled: DataFrame | None = None) -> DataFrame:
    """Rows cfg_id, a, b, relation for every two events of a graph (a < b) (Q25). unmodeled (cfg_id, event): under a gap, unknown.

    events: cfg_id, event, block, ordinal; edges: cfg_id, src, dst; the entry is block 0.
    """
    rows = _packed(events, edges)
    hidden = unmodeled.groupBy("cfg_id").agg(F.collect_set("event").alias("hidden")) if unmodeled is not None else None
    rows = rows.join(hidden, "cfg_id", "left") if hidden is not None else rows.withColumn("hidden", F.array().cast("array<long>"))
    # a large graph is many rows: events by slices, each with itself and each later one
    slices = F.sequence(F.lit(0), F.expr(f"cast((size(events) - 1) div {SLICE} as int)"))
    at = lambda i: F.slice("events", F.col(i) * SLICE + 1, F.lit(SLICE))
    rows = rows.withColumn("i", F.explode(slices)).withColumn("j", F.explode(F.filter(slices, lambda j: j >= F.col("i"))))
    rows = rows.select("cfg_id", "edges", "hidden", at("i").alias("events"), F.when(F.col("i") != F.col("j"), at("j")).alias("later"))
    kinds = pa.array(RELATIONS)

    def run(batches):
        for batch in batches:
            for cfg, flow, gaps, own, later in zip(*(batch.column(c) for c in ("cfg_id", "edges", "hidden", "events", "later")), strict=True):
                graph = Flow([(x["src"], x["dst"]) for x in flow.as_py() or ()])
                gone = np.array(gaps.as_py() or (), dtype="int64")
                a = _fields(own)
                b = _fields(later) if later.is_valid else a
                blocks, where = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
                table = np.array([[CODE[graph.relate((int(x), 0), (int(y), 0))] for y in blocks] for x in blocks], dtype="int8").reshape(len(blocks), len(blocks))
                wa, wb = where[: len(a[1])], where[len(a[1]) :]
                lost_a, lost_b = np.isin(a[0], gone), np.isin(b[0], gone)
                step = max(1, PAIRS // max(1, len(b[0])))
                for lo in range(0, len(a[0]), step):
                    x, y = np.arange(lo, min(lo + step, len(a[0]))), np.arange(len(b[0]))
                    x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                    if not later.is_valid:
                        x, y = x[x < y], y[x < y]
                    code = table[wa[x], wb[y]]
                    tied = (wa[x] == wb[y]) & (code == CODE["unordered"])
                    code = np.where(tied & (a[2][x] < b[2][y]), CODE["sequenced_before"], np.where(tied & (a[2][x] > b[2][y]), CODE["may_follow"], code))
                    code = np.where(lost_a[x] | lost_b[y], CODE["unknown"], code)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cfg.as_py(), dtype="int64")), pa.array(a[0][x]), pa.array(b[0][y]), kinds.take(pa.array(code))], ["cfg_id", "a", "b", "relation"])

    return rows.mapInArrow(run, "cfg_id long, a long, b long, relation string")


def dominator_pairs(edges: DataFrame) -> DataFrame:
    """Rows cfg_id, block, dominator, itself left out (Q26)."""
    rows = edges.groupBy("cfg_id").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))

    def run(frames):
        for frame in frames:
            out = [(cfg, b, d) for cfg, e in zip(frame.cfg_id, frame.edges, strict=True) for b, found in Flow([(x["src"], x["dst"]) for x in e]).dominators().items() for d in found if d != b]
            yield pd.DataFrame(out, columns=["cfg_id", "block", "dominator"]).astype("int64")

    return rows.mapInPandas(run, "cfg_id long, block long, dominator long")


def combined(relations: DataFrame, by: list[str]) -> DataFrame:
    """One relation for several variants or callers: the strongest claim that all allow (Q28)."""
    bit = F.lit(0)
    for name, code in CODE.items():
        bit = F.when(F.col("relation") == name, 1 << code).otherwise(bit)
    sets = relations.groupBy(*by).agg(F.bit_or(bit).alias("r"))
    mask = lambda *names: sum(1 << CODE[n] for n in names)
    has = lambda *names: F.col("r").bitwiseAND(mask(*names)) != 0
    proofs = ~has(*(n for n in RELATIONS if n not in ("sequenced_before", "guaranteed_before")))
    precede, follow = has("sequenced_before", "guaranteed_before", "may_precede", "may_both", "unordered"), has("may_follow", "may_both", "unordered")
    kind = F.lit(None).cast("string")
    for name, code in CODE.items():
        kind = F.when(F.col("r") == 1 << code, name).otherwise(kind)
    kind = F.coalesce(
        kind, F.when(has("unknown"), "unknown").when(proofs, "guaranteed_before").when(precede & follow, "may_both").when(precede, "may_precede").when(follow, "may_follow").otherwise("exclusive")
    )
    return sets.select(*by, kind.alias("relation"))


def unordered_runs(events: DataFrame) -> DataFrame:
    """Rows cfg_id, block, ordinal, events: groups of at least two events of a block without an order (Q31)."""
    runs = events.groupBy("cfg_id", "block", "ordinal").agg(F.sort_array(F.collect_list("event")).alias("events"))
    return runs.where(F.size("events") > 1)


def inline(events: DataFrame, calls: DataFrame, root: int, depth: int, max_frames: int = 32) -> DataFrame:
    """Frames of a bounded expansion: frame, parent event, cfg_id, depth, boundary (Q29).

    calls: event, callee (a cfg_id; null where unknown). A callee already open above is a recursion, one without
    a body an omitted body; both end there. Frames beyond max_frames are not opened, in order of depth and event.
    """
    spark = events.sparkSession
    bodies = events.select(F.col("cfg_id").alias("callee"), F.lit(True).alias("body")).distinct()
    level = spark.createDataFrame([(root, None, 0, None, [root])], "cfg_id long, event long, depth int, boundary string, above array<long>")
    out = level
    for d in range(1, depth + 1):
        step = level.where("boundary is null").select("cfg_id", "above").join(events.select("cfg_id", F.col("event").alias("e")), "cfg_id").join(calls.select(F.col("event").alias("e"), "callee"), "e").join(bodies, "callee", "left")
        kind = F.when(F.col("callee").isNull(), "unknown_callee").when(F.array_contains("above", F.col("callee")), "recursion").when(F.col("body").isNull(), "omitted_body")
        level = step.select(F.col("callee").alias("cfg_id"), F.col("e").alias("event"), F.lit(d).alias("depth"), kind.alias("boundary"), F.concat("above", F.array("callee")).alias("above"))
        out = out.unionByName(level)
    return out.orderBy("depth", "event", "cfg_id").limit(max_frames).select("cfg_id", "event", "depth", "boundary")


def events_at(events: DataFrame, sites: DataFrame, file_id: int, line: int) -> DataFrame:
    """Events whose call is spelled or expanded at a line (Q24). events: event, call_site_id."""
    spelled = sites.where((F.col("file_id") == file_id) & (F.col("line") == line)).select(F.col("id").alias("call_site_id"))
    expanded = sites.where((F.col("expansion_file_id") == file_id) & (F.col("expansion_line") == line)).select(F.col("id").alias("call_site_id"))
    return events.join(spelled.union(expanded).distinct(), "call_site_id", "left_semi")


def between(relations: DataFrame, cfg_id: int, first: int, last: int) -> DataFrame:
    """Events of a graph that may run after first and before last (Q30, scope between)."""
    own = relations.where(F.col("cfg_id") == cfg_id)
    ahead = ("sequenced_before", "guaranteed_before", "may_precede", "may_both")
    behind = ("may_follow", "may_both")
    later = own.where((F.col("a") == first) & F.col("relation").isin(*ahead)).select(F.col("b").alias("event")).union(own.where((F.col("b") == first) & F.col("relation").isin(*behind)).select(F.col("a").alias("event")))
    earlier = own.where((F.col("b") == last) & F.col("relation").isin(*ahead)).select(F.col("a").alias("event")).union(own.where((F.col("a") == last) & F.col("relation").isin(*behind)).select(F.col("b").alias("event")))
    return later.intersect(earlier).distinct()


def event_targets(events: DataFrame, event_sites: DataFrame, call_edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows cfg_id, event, callee_fn_id, name, resolution, is_defined, is_dep: what each event may call."""
    e = call_edges.where("call_site_id is not null").select("call_site_id", "callee_fn_id", "resolution")
    f = functions.select(F.col("id").alias("callee_fn_id"), "name", "is_defined", "is_dep")
    rows = events.select("cfg_id", "event").join(event_sites.select("event", "call_site_id"), "event").join(e, "call_site_id").join(f, "callee_fn_id")
    return rows.select("cfg_id", "event", "callee_fn_id", "name", "resolution", "is_defined", "is_dep").distinct()


def variants_in(graphs: DataFrame, blocks: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Graphs (cfg_id, fn_id, variant) compiled from, or with a block written in, a file whose path holds the text.

    graphs: cfg_id, fn_id, tu_file_id, variant; blocks: cfg_id, file_id. Case of A-Z doesn't count.
    """
    from factloom.operators.relational import contains_ascii_folded

    held = files.where(contains_ascii_folded(F.col("path"), text)).select(F.col("id").alias("file_id"))
    own = graphs.select("cfg_id", F.col("tu_file_id").alias("file_id")).join(held, "file_id", "left_semi").select("cfg_id")
    inside = blocks.join(held, "file_id", "left_semi").select("cfg_id")
    return graphs.join(own.unionByName(inside).distinct(), "cfg_id", "left_semi").select("cfg_id", "fn_id", "variant")


def scope_events(events: DataFrame, relations: DataFrame, cfg_id: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events of a graph in a scope (Q30): all of the function, those that may run from first on, up to last, or between both; ends are in it."""
    own = events.where(F.col("cfg_id") == cfg_id).select("event")
    ahead, behind = ("sequenced_before", "guaranteed_before", "may_precede", "may_both", "unordered"), ("may_follow", "may_both", "unordered")
    r = relations.where(F.col("cfg_id") == cfg_id)

    def side(event: int, later: bool) -> DataFrame:
        x, y = (ahead, behind) if later else (behind, ahead)
        of_a = r.where((F.col("a") == event) & F.col("relation").isin(*x)).select(F.col("b").alias("event"))
        of_b = r.where((F.col("b") == event) & F.col("relation").isin(*y)).select(F.col("a").alias("event"))
        return of_a.unionByName(of_b).unionByName(own.where(F.col("event") == event)).distinct()

    if first is not None:
        own = own.join(side(first, True), "event", "left_semi")
    if last is not None:
        own = own.join(side(last, False), "event", "left_semi")
    return own
