"""Walks over edge tables: bounded searches, chains, closures, components, waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.loop import compact, cut, cut_counted, discard, grow, hinted
from factloom.operators.relational import matches_any
from factloom.sources.facts import FactSet


class QueryGraph:
    """A result: nodes (id, depth), edges with ends a and b, and whether the depth cut something off."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, truncated: DataFrame):
        self.nodes, self.edges, self.truncated = nodes, edges, truncated


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, down: bool = True, stored: bool = False) -> QueryGraph:
    """Breadth-first search from roots (id), depth steps along or against edges (a, b, more columns).

    Every node has its least depth. The edges are all those that leave a node of less than the full depth;
    the result is cut off if one of the full depth leads to a node that wasn't reached. stored: the edges are
    a table's, so they needn't be written once for all rounds.
    """
    near, far = ("a", "b") if down else ("b", "a")
    edges = edges if stored else cut(edges)
    e = edges.select(F.col(near).alias("id"), F.col(far).alias("next"))
    step = lambda delta, _, r: delta.join(e, "id").select(F.col("next").alias("id"), F.lit(r).alias("depth"))
    nodes, _ = grow(roots.select("id", F.lit(0).alias("depth")), step, ["id"], limit=depth)
    nodes, n = cut_counted(nodes)
    inner = nodes.where(F.col("depth") < depth).select(F.col("id").alias(near))
    kept = edges.join(hinted(inner, n), near, "left_semi")
    rim = e.join(hinted(nodes.where(F.col("depth") == depth), n), "id", "left_semi").select(F.col("next").alias("id"))
    truncated = rim.join(hinted(nodes, n), "id", "left_anti").limit(1).agg((F.count("*") > 0).alias("truncated"))
    return QueryGraph(nodes, kept, truncated)


def call_graph(facts: FactSet, root: int, depth: int, down: bool = True) -> QueryGraph:
    """Functions and edges around a function; going down, calls without an edge are leaves with negative ids (Q5)."""
    from factloom.operators.relational import leaves_of

    edges = cut(facts["call_edges"].select(F.col("caller_fn_id").alias("a"), F.col("callee_fn_id").alias("b"), "resolution", "call_site_id"))
    spark = edges.sparkSession
    found = neighbourhood(edges, spark.createDataFrame([(root,)], "id long"), depth, down, stored=True)
    found = QueryGraph(found.nodes, found.edges.distinct(), found.truncated)
    if not down:
        return found
    inner = found.nodes.where(F.col("depth") < depth)
    held = hinted(inner.select(F.col("id").alias("caller_fn_id")), inner.count())
    sites = facts["call_sites"].join(held, "caller_fn_id", "left_semi")
    few = sites.select("id").distinct()
    bound = edges.select(F.col("call_site_id").alias("id")).join(few, "id", "left_semi").distinct()
    leaves = leaves_of(sites.join(bound, "id", "left_anti"), facts["files"]).select(F.col("caller_fn_id").alias("id"), "node").join(inner, "id")
    nodes = found.nodes.unionByName(leaves.select(F.col("node").alias("id"), (F.col("depth") + 1).alias("depth")))
    kept = found.edges.unionByName(leaves.select(F.col("id").alias("a"), F.col("node").alias("b"), F.lit("unresolved").alias("resolution"), F.lit(None).cast("long").alias("call_site_id")))
    return QueryGraph(nodes, kept, found.truncated)


def dataflow_graph(facts: FactSet, starts: DataFrame, depth: int, down: bool = True) -> QueryGraph:
    """Nodes around the start nodes (id) over flow edges of every kind (Q10)."""
    edges = facts["flow_edges"].select(F.col("src_node").alias("a"), F.col("dst_node").alias("b"), "kind")
    return neighbourhood(edges, starts, depth, down)


def chains(edges: DataFrame, start: int, end: int, depth: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Simple paths of at most depth edges from start to end: rows length, nodes, edges; and whether the limit cut some off (Q6).

    A path stops at the end. With start = end there are the empty path and the cycles back. Parallel edges give
    paths of their own. Only nodes from which the end is near enough are walked on to. With a limit, the first
    paths in the order of their edge lists are kept (O6). The result is ordered by length, then nodes (O5).
    edges has id, a, b.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("id", "a", "b"))
    near = neighbourhood(edges, spark.createDataFrame([(end,)], "id long"), depth, down=False, stored=True).nodes.select(F.col("id").alias("b"), F.col("depth").alias("left"))
    e = cut(edges.join(near, "b").where(F.col("left") < depth).select("a", F.struct("b", "id").alias("e"), "left"))
    live = cut(spark.createDataFrame([(start, [start], [])], "at long, nodes array<long>, edges array<struct<b:long,id:long>>"))
    done = [live.where(F.lit(start == end))]
    for used in range(1, depth + 1):
        to = F.col("e.b")
        step = live.join(e.where(F.col("left") <= depth - used), F.col("at") == F.col("a")).where((to == end) | ~F.array_contains("nodes", to))
        step, n = cut_counted(step.select(to.alias("at"), F.concat("nodes", F.array(to)).alias("nodes"), F.concat("edges", F.array("e")).alias("edges")))
        if not n:
            break
        done.append(step.where(F.col("at") == end))
        live = step.where(F.col("at") != end)
    paths = done[0]
    for d in done[1:]:
        paths = paths.unionByName(d)
    truncated = spark.createDataFrame([(False,)], "truncated boolean")
    if limit is not None:
        first = cut(paths.orderBy("edges").limit(limit + 1))
        truncated = first.agg((F.count("*") > limit).alias("truncated"))
        paths = first.orderBy("edges").limit(limit)
    out = paths.select(F.size("edges").cast("long").alias("length"), "nodes", F.transform("edges", lambda x: x["id"]).alias("edges"))
    return out.orderBy("length", "nodes", "edges"), truncated


def chain_graph(paths: DataFrame) -> DataFrame:
    """Nodes of the paths with their least place (Q33)."""
    return paths.select(F.posexplode("nodes").alias("depth", "id")).groupBy("id").agg(F.min("depth").cast("long").alias("depth"))


def filter_graph(graph: QueryGraph, names: DataFrame, roots: DataFrame, patterns: list[str]) -> QueryGraph:
    """Keeps edges of which an end's name matches, then ranks what the roots still reach; roots always stay (Q32).

    names has id and name. Parts that the roots no longer reach keep their edges and hang at the depth they had.
    """
    ok = names.where(matches_any(F.col("name"), patterns)).select("id")
    a = graph.edges.join(ok.withColumnRenamed("id", "a"), "a", "left_semi")
    b = graph.edges.join(ok.withColumnRenamed("id", "b"), "b", "left_semi")
    kept = cut(a.unionByName(b).distinct())
    reached = neighbourhood(kept, roots, 1 << 20, stored=True).nodes
    ends = kept.select(F.col("a").alias("id")).unionByName(kept.select(F.col("b").alias("id"))).distinct()
    rest = ends.join(reached, "id", "left_anti").join(graph.nodes, "id")
    return QueryGraph(reached.unionByName(rest.select("id", "depth")), kept, graph.truncated)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes (id) that starts (id) reach over edges (a, b), with themselves."""
    e = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("next")).distinct())
    found, _ = grow(starts.select("id"), lambda delta, _, __: delta.join(e, "id").select(F.col("next").alias("id")), ["id"])
    return found


def closure(edges: DataFrame, starts: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """Rows start, id, distance over edges (a, b): every start's reach with the least distance, itself at 0; cycles are no trouble.

    stop (id): nodes that are reached but not walked on from, unless they are starts.
    """
    e = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("next")).distinct())
    starts = starts.select(F.col("id").alias("start")) if starts is not None else e.select(F.col("id").alias("start")).unionByName(e.select(F.col("next").alias("start"))).distinct()

    def step(delta, _, r):
        if stop is not None:
            delta = delta.join(stop.select("id").withColumn("__stop", F.lit(1)), "id", "left").where("__stop is null or id = start").drop("__stop")
        return delta.join(e, "id").select("start", F.col("next").alias("id"), F.lit(r).alias("distance"))

    found, _ = grow(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("distance")), step, ["start", "id"])
    return found


def ancestors(inheritance: DataFrame) -> DataFrame:
    """Bases of every class, with the least distance."""
    return closure(inheritance.select(F.col("derived").alias("a"), F.col("base").alias("b"))).where("start <> id").select(F.col("start").alias("class_id"), F.col("id").alias("base"), F.col("distance").cast("long"))


def virtual_targets(facts: FactSet, name: str) -> DataFrame:
    """What a virtual call of the method on each class may run: for every class below, the nearest declaration upward."""
    up = facts["inheritance"].select(F.col("derived").alias("a"), F.col("base").alias("b"))
    classes = up.select(F.col("a").alias("id")).unionByName(up.select(F.col("b").alias("id"))).distinct()
    own = facts["methods"].where(F.col("name") == name).select(F.col("class_id").alias("id"), "fn_id")
    above = cut(closure(up, classes))
    seen = above.join(own, "id")
    best = seen.groupBy("start").agg(F.min(F.struct("distance", "fn_id")).alias("m")).select(F.col("start").alias("id"), F.col("m.fn_id").alias("fn_id"))
    below = above.select(F.col("id").alias("class_id"), F.col("start").alias("id"))
    return below.join(best, "id").select("class_id", "fn_id").distinct()


def derives_from(inheritance: DataFrame, base: int) -> DataFrame:
    """Classes below a class, itself left out unless it lies on a cycle."""
    down = inheritance.select(F.col("base").alias("a"), F.col("derived").alias("b"))
    first = down.where(F.col("a") == base).select(F.col("b").alias("id")).distinct()
    return reachable(down, first)


#: Rounds in which nodes without edges in or out are taken off before labels are sent.
TRIMS = 6


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows id, component (its least node) over edges (a, b).

    Nodes that nothing enters or leaves are components of their own and go first, a bounded number of times.
    Then forward and backward least-label walks: nodes whose least label from ahead and from behind is one and
    the same node lie on a cycle with it. Settled components leave; the rest go on without edges between
    different label pairs, so each round only looks inside pieces that may still hold components.
    """
    e, n = cut_counted(edges.select("a", "b").distinct())
    left = cut(e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct())
    done = None

    def settle(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    e, n = cut_counted(e.where("a <> b"))
    while True:
        for _ in range(TRIMS):
            marks = e.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
            inner, k = cut_counted(marks.groupBy("id").agg(F.max("out").alias("out"), F.max("into").alias("into")).where("out = 1 and into = 1").select("id"))
            gone, g = cut_counted(left.join(hinted(inner, k), "id", "left_anti"))
            if not g:
                break
            settle(gone.select("id", F.col("id").alias("component")))
            left = inner
            e, n = cut_counted(compact(e.join(hinted(inner.withColumnRenamed("id", "a"), k), "a", "left_semi").join(hinted(inner.withColumnRenamed("id", "b"), k), "b", "left_semi").select("a", "b"), n))
            if not n:
                break
        if not n:
            settle(left.select("id", F.col("id").alias("component")))
            return done
        labels = cut(_least_labels(e, left, "a", "b").join(_least_labels(e, left, "b", "a").withColumnRenamed("label", "back"), "id"))
        settle(labels.where("label = back").select("id", F.col("label").alias("component")))
        left, open_ = cut_counted(labels.where("label <> back").select("id", "label", "back"))
        if not open_:
            return done
        pair = lambda side: left.select(F.col("id").alias(side), F.col("label").alias(f"{side}1"), F.col("back").alias(f"{side}2"))
        e, n = cut_counted(e.join(pair("a"), "a").join(pair("b"), "b").where("a1 = b1 and a2 = b2").select("a", "b"))
        left = left.select("id")


def _least_labels(e: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """For every node the least node that reaches it over edges from a to b, itself included."""
    labels = nodes.select("id", F.col("id").alias("label"))
    delta = labels
    while True:
        sent = delta.join(e, F.col("id") == F.col(a)).groupBy(F.col(b).alias("to")).agg(F.min("label").alias("new"))
        rows = cut(labels.join(sent, F.col("id") == F.col("to"), "left").select("id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("changed")))
        discard(labels)
        labels, delta = rows.select("id", "label"), rows.where("changed").select("id", "label")
        n = delta.count()
        if not n:
            return labels
        delta = hinted(delta, n)


def waves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows id, wave: a node's wave comes after those of all it depends on (edges a -> b); null for what hangs on a cycle (Q35).

    Each round takes the nodes without open dependencies off and the edges into them with them: edges and nodes only shrink.
    """
    e, open_ = cut_counted(edges.select("a", "b").where("a <> b").distinct())
    left, n_left = cut_counted(nodes.select("id").distinct())
    out, wave = None, 0
    while n_left:
        rows, _ = cut_counted(left.join(e.select(F.col("a").alias("id"), F.lit(False).alias("free")).distinct(), "id", "left").select("id", F.coalesce("free", F.lit(True)).alias("free")))
        ready, n = cut_counted(rows.where("free").select("id"))
        if not n:
            break
        own = ready.select("id", F.lit(wave).cast("long").alias("wave"))
        out = own if out is None else out.unionByName(own)
        n_left -= n
        left = rows.where("not free").select("id")
        if open_:
            old, (e, open_) = e, cut_counted(compact(e.join(hinted(ready.withColumnRenamed("id", "b"), n), "b", "left_anti").select("a", "b"), open_))
            discard(old)
        wave += 1
    rest = left.select("id", F.lit(None).cast("long").alias("wave"))
    return rest if out is None else out.unionByName(rest)


def shallowest(rows: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """The first row of each group by depth."""
    w = W.partitionBy(*by).orderBy(depth)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
