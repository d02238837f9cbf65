"""Source-level dataflow: technical nodes cost nothing to pass and vanish from the result; slices and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import reachable, strong_components
from factloom.operators.loop import cut, grow, grow_behind, hinted

#: Characters of lists of contexts that are broadcast at most.
BROADCAST_TEXT = 32 << 20


def visible_neighbourhood(edges: DataFrame, starts: DataFrame, hidden: DataFrame, depth: int, aliases: DataFrame | None = None) -> DataFrame:
    """Rows id, level: walks edges (a, b) from starts (id); leaving a hidden node costs nothing, any other but a start one (Q11).

    aliases (a, b, both directions): the same thing under two ids, at no cost. Levels are least costs.
    """
    free = starts.select("id").unionByName(hidden.select("id")).distinct().select(F.col("id").alias("a"), F.lit(True).alias("free"))
    e = cut(edges.select("a", "b").distinct().join(free, "a", "left").select("a", "b", F.col("free").isNotNull().alias("free")))
    onward = lambda rows, free: rows.select("id").join(e.where(F.col("free") == free), F.col("id") == F.col("a")).select(F.col("b").alias("id"))

    def passing(delta, _, __):
        found = onward(delta, True)
        return found.unionByName(delta.select("id").join(aliases, F.col("id") == F.col("a")).select(F.col("b").alias("id"))) if aliases is not None else found

    known, total = None, 0
    rows, n = starts.select("id"), 0
    for level in range(depth + 1):  # a level is complete before the next begins, so no node is met at a worse one
        own, _, n = grow_behind(rows, passing, ["id"], before=(known, total) if known is not None else None)
        if not n:
            break
        own, known, total = hinted(own, n), own.withColumn("level", F.lit(level)) if known is None else known.unionByName(own.withColumn("level", F.lit(level))), total + n
        rows = onward(own, False)
    return known if known is not None else starts.select("id", F.lit(0).alias("level"))


def collapse_hidden(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges a, b, operations between visible nodes: paths through hidden ones become one edge with all operations on any of them (Q12).

    edges: a, b, operation. What hidden nodes lead to is found once, for all visible nodes before them; paths are never listed.
    """
    h = hidden.select("id").distinct()
    mark = lambda side, out: h.select(F.col("id").alias(side), F.lit(True).alias(out))
    e = edges.select("a", "b", F.col("operation").alias("op")).distinct().join(mark("b", "hb"), "b", "left").join(mark("a", "ha"), "a", "left")
    e = cut(e.select("a", "b", "op", F.col("ha").isNotNull().alias("ha"), F.col("hb").isNotNull().alias("hb")))
    part = lambda ha, hb: e.where((F.col("ha") == ha) & (F.col("hb") == hb)).select("a", "b", "op")

    def after(rows: DataFrame, tails: DataFrame) -> DataFrame:
        """rows (a, b, op) led on by tails from b: the pair has the operations of both."""
        t = tails.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("op").alias("op2"))
        return rows.join(t, "b").select("a", F.col("to").alias("b"), F.explode(F.array_distinct(F.array("op", "op2"))).alias("op"))

    inner, out = cut(part(True, True)), part(True, False)
    reach, _ = grow(inner, lambda delta, _, __: after(delta, inner), ["a", "b", "op"])
    ends = cut(out.unionByName(after(reach, out)).distinct())
    rows = part(False, False).unionByName(after(part(False, True), ends))
    return rows.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("op")), ",").alias("operations"))


def edge_role(kind: Column) -> Column:
    """What an edge means to a slice."""
    return (
        F.when(kind.isin("copy", "call_arg", "unwrap", "dlsym", "mem_read", "mem_write"), "value").when(kind == "points_to", "storage").when(kind == "addr_of", "address")
        .when(kind == "gep", "field").when(kind.isin("load", "store", "terminates"), kind).otherwise("other")
    )


def memory_edges(accesses: DataFrame) -> DataFrame:
    """Value edges through cells: a store into a cell meets every load of it (Q20). accesses: kind, src, dst, cell."""
    stores = accesses.where("kind = 'store' and cell is not null").select("src", "cell")
    loads = accesses.where("kind = 'load' and cell is not null").select("dst", "cell")
    write = stores.select(F.col("src").alias("src_node"), F.col("cell").alias("dst_node"), F.lit("mem_write").alias("kind"))
    read = loads.select(F.col("cell").alias("src_node"), F.col("dst").alias("dst_node"), F.lit("mem_read").alias("kind"))
    return write.unionByName(read).distinct()


def value_slice(edges: DataFrame, start: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Rows id, side: up, where the values of start (id) come from over value and storage edges; down, where they and their sources' values go (Q18, Q19).

    stops (id): boundaries that are reached but not passed. A node on both sides is marked both.
    """
    e = edges.where(edge_role(F.col("kind")).isin("value", "storage")).select("src_node", "dst_node").distinct()

    def open_(side: str) -> DataFrame:
        return e if stops is None else e.join(stops.select(F.col("id").alias(side)), side, "left_anti")

    up = cut(reachable(open_("dst_node").select(F.col("dst_node").alias("a"), F.col("src_node").alias("b")), start))
    fed = e.select(F.col("dst_node").alias("id")).distinct()
    sources = up.join(fed, "id", "left_anti").unionByName(start.select("id")).distinct()
    down = reachable(open_("src_node").select(F.col("src_node").alias("a"), F.col("dst_node").alias("b")), sources)
    both = up.withColumn("u", F.lit(1)).join(down.withColumn("d", F.lit(1)), "id", "full")
    return both.select("id", F.when(F.col("u").isNull(), "down").when(F.col("d").isNull(), "up").otherwise("both").alias("side"))


def context_sets(contexts: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows fn, context: the contexts whose entries reach a function; 0 (root) for what hangs on a component nobody calls (Q21).

    contexts: id, entry; calls: a, b; functions: id.
    """
    e = cut(calls.select("a", "b").distinct())
    started, _ = grow(contexts.select(F.col("entry").alias("fn"), F.col("id").alias("context")), lambda d, _, __: d.join(e, F.col("fn") == F.col("a")).select(F.col("b").alias("fn"), "context"), ["fn", "context"])
    comp = strong_components(e)
    inside = e.join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    called = inside.where("ca <> cb").select(F.col("cb").alias("component")).distinct()
    roots = comp.join(called, "component", "left_anti").select("id").unionByName(functions.select("id").join(comp.select("id"), "id", "left_anti"))
    roots = cut(roots.join(contexts.select(F.col("entry").alias("id")), "id", "left_anti"))
    rooted = reachable(e, roots).select(F.col("id").alias("fn"), F.lit(0).cast("long").alias("context"))
    return started.unionByName(rooted).distinct()


def cross_context(nodes: DataFrame, sets: DataFrame, self_concurrent: DataFrame) -> DataFrame:
    """Rows node, contexts, crosses: nodes touched from two contexts, or from one that runs beside itself.

    nodes: node, fn; self_concurrent: id. Nodes of the same functions share one list of contexts, made once.
    """
    placed = cut(nodes.where("fn is not null").groupBy("node").agg(F.sort_array(F.collect_set("fn")).alias("fns")))
    twice = self_concurrent.select(F.col("id").alias("context"), F.lit(1).alias("twice")).distinct()
    own = placed.select("fns").distinct().select("fns", F.explode("fns").alias("fn")).join(sets, "fn").select("fns", "context").distinct().join(twice, "context", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_set("context")), lambda x: x.cast("string")), ",")
    by = own.groupBy("fns").agg(text.alias("contexts"), (F.count("context") > 1).alias("several"), F.max("twice").alias("twice"))
    by = cut(by.select("fns", "contexts", (F.col("several") | F.col("twice").isNotNull()).alias("crosses")))
    held = by.agg(F.sum(F.length("contexts"))).first()[0] or 0
    return placed.join(F.broadcast(by) if held <= BROADCAST_TEXT else by, "fns").select("node", "contexts", "crosses")


#: Variables and locations whose storage outlives a call.
STATIC = ("global", "file_static", "fn_static")


def sharing(nodes: DataFrame) -> DataFrame:
    """Rows id, sharing (Q23): variables of static storage are shared, constants and the addresses of functions and string literals
    constant, locations of a call's own storage (a local's, a field of a local or parameter) private, other locations shared, all else private.

    nodes: id, kind, var_kind, loc_kind (of locations).
    """
    loc = F.col("kind") == "loc"
    own = (F.col("loc_kind") == "local") | ((F.col("loc_kind") == "field") & F.col("var_kind").isin("local", "param"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(yes((F.col("kind") == "var") & F.col("var_kind").isin(*STATIC)), "shared").when(F.col("kind") == "constant", "constant")
        .when(yes(loc & F.col("loc_kind").isin("function", "string_lit")), "constant").when(yes(loc & own), "private").when(loc, "shared").otherwise("private")
    )
    return nodes.select("id", kind.alias("sharing"))


def dataflow_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, document: the graph as JSON, nodes and edges in order (Q16). nodes: id, label, level; edges: a, b, operation."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "label", "level"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("from"), F.col("b").alias("to"), "operation"))).alias("edges"))
    return n.join(F.broadcast(e), F.lit(True)).select(F.to_json(F.struct("nodes", "edges")).alias("document"))


def assignment_target(text: Column) -> Column:
    """What stands left of an assignment, without comments and text literals; null if there is none (Q14)."""
    plain = F.regexp_replace(F.regexp_replace(text, r"/\*(?s:.*?)\*/|//[^\n]*", " "), r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "0")
    left = F.trim(F.regexp_extract(plain, r"^([^=;{}]*?)\s*(?:<<|>>|[-+*/%&|^])?=(?!=)", 1))
    return F.when((left != "") & ~left.rlike(r"[!<>]$"), left)


def slice_start(facts_like: dict[str, DataFrame], file_id: int, line: int, col: int) -> DataFrame:
    """Node ids a position may mean: variables there, arguments and fields of calls there.

    facts_like: name -> rows id, file_id, line, col, width. A hit covers the column; of several the nearest start counts.
    """
    out = None
    for rank, (name, df) in enumerate(facts_like.items()):
        hit = df.where((F.col("file_id") == file_id) & (F.col("line") == line) & (F.col("col") <= col) & (F.lit(col) < F.col("col") + F.col("width")))
        rows = hit.select("id", (F.lit(col) - F.col("col")).alias("off"), F.lit(rank).alias("rank"), F.lit(name).alias("meaning"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("id").agg(F.min(F.struct("off", "rank", "meaning")).alias("m")).select("id", F.col("m.off").cast("long").alias("off"), F.col("m.meaning").alias("meaning"))
