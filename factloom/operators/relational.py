"""Relational queries over facts: filters, joins, ranks and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.blocks import block_join
from factloom.sources.facts import FactSet

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = {"upper": _UPPER, "lower": _LOWER}


# Predicates.


def contains(c: Column, literal: str) -> Column:
    """Literal substring; case counts."""
    return F.instr(c, F.lit(literal)) > 0


def contains_ascii_folded(c: Column, literal: str) -> Column:
    """Literal substring; A-Z and a-z are alike, other letters are not."""
    return F.instr(F.translate(c, _UPPER, _LOWER), F.lit(literal.translate(str.maketrans(_UPPER, _LOWER)))) > 0


def names_function(c: Column, name: str) -> Column:
    """The name itself, or a qualified name that ends with it."""
    return (c == name) | c.endswith("::" + name)


def has_location(line: Column) -> Column:
    """P5: line 0 stands for no location."""
    return line > 0


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Any of the patterns is found in the text."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


# Call edges.


def call_rows(facts: FactSet) -> DataFrame:
    """Every call edge whose functions have files, and where the call is spelled and expanded, if anywhere."""
    f, files = facts.require("functions"), facts.require("files").select("id", "path")
    side = lambda p: f.join(files.withColumnRenamed("id", "file_id"), "file_id").select(
        *[F.col(c).alias(f"{p}_{c}") for c in ("id", "name", "path", "line_start", "is_dep", "is_defined")]
    )
    spelled = files.select(F.col("id").alias("file_id"), F.col("path").alias("site_path"))
    expanded = files.select(F.col("id").alias("expansion_file_id"), F.col("path").alias("expansion_path"))
    sites = facts.require("call_sites").withColumnRenamed("id", "call_site_id").drop("caller_fn_id")
    sites = sites.join(spelled, "file_id", "left").join(expanded, "expansion_file_id", "left")
    return (
        facts.require("call_edges")
        .join(side("caller"), F.col("caller_fn_id") == F.col("caller_id"))
        .join(side("callee"), F.col("callee_fn_id") == F.col("callee_id"))
        .join(sites, "call_site_id", "left")
    )


def calls(facts: FactSet, from_: str | None = None, to: str | None = None, file: str | None = None, exclude_deps: bool = False) -> DataFrame:
    """Call edges, filtered by caller, callee, file text and dependencies; those with a site first, then by place (Q1, O1).

    A file text is looked for where the call is spelled or expanded, in the callee's own file if it has a place there,
    and in the caller's file only for an edge without a site.
    """
    rows = call_rows(facts)
    if from_:
        rows = rows.where(names_function(F.col("caller_name"), from_))
    if to:
        rows = rows.where(names_function(F.col("callee_name"), to))
    if file:
        held = lambda p: F.coalesce(contains_ascii_folded(F.col(p), file), F.lit(False))
        in_callee = held("callee_path") & has_location(F.col("callee_line_start"))
        rows = rows.where(held("site_path") | held("expansion_path") | in_callee | (F.col("call_site_id").isNull() & held("caller_path")))
    if exclude_deps:
        rows = rows.where((F.col("caller_is_dep") == 0) & (F.col("callee_is_dep") == 0))
    path, line = F.coalesce("expansion_path", "site_path"), F.coalesce("expansion_line", "line")
    picked = rows.select("id", F.col("caller_name").alias("caller"), F.col("callee_name").alias("callee"), "resolution", path.alias("path"), line.alias("line"), F.coalesce("expansion_col", "col").alias("col"))
    return picked.orderBy(F.col("path").isNull(), "path", "line", "id")  # without a spelling there is no expansion


def display_filter(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Edges of which the caller or the callee matches a pattern."""
    return rows.where(matches_any(F.col("caller"), patterns) | matches_any(F.col("callee"), patterns))


def editor_calls(facts: FactSet, fn_id: int, incoming: bool) -> DataFrame:
    """One hop from a function with the place to show: the expansion if it is in the caller's file, else the spelling there."""
    f = facts["functions"].select(F.col("id").alias("f"), F.col("file_id").alias("own_file"))
    own, other = ("callee_fn_id", "caller_fn_id") if incoming else ("caller_fn_id", "callee_fn_id")
    sites = facts["call_sites"].withColumnRenamed("id", "call_site_id").drop("caller_fn_id")
    rows = facts["call_edges"].where(F.col(own) == fn_id).join(f, F.col("caller_fn_id") == F.col("f")).join(sites, "call_site_id", "left")
    at = F.col("expansion_file_id") == F.col("own_file")
    here = F.col("file_id") == F.col("own_file")
    place = lambda a, b: F.when(at, F.col(a)).when(here, F.col(b))
    return rows.select("id", F.col(other).alias("peer"), place("expansion_line", "line").alias("line"), place("expansion_col", "col").alias("col")).orderBy("peer", "line", "col", "id")


# Q2, J2.


def diagnostics(facts: FactSet, stage: str | None = None, severity: str | None = None, file: str | None = None) -> DataFrame:
    """Diagnostics with their files, if any; filters that aren't given don't filter."""
    rows = facts.require("diagnostics").join(facts["files"].select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    if stage is not None:
        rows = rows.where(F.col("stage") == stage)
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if file is not None:
        rows = rows.where(contains(F.col("path"), file))
    return rows.select("id", "stage", "severity", "path", "line", "message").orderBy("id")


# Q3, Q4, O2, O3, J3, J12.


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("width", F.col("line_end") - F.col("line_start")).orderBy(F.col("is_defined").desc(), "width", "name", "id")


def functions_at(facts: FactSet, file: str, line: int) -> DataFrame:
    """Functions whose lines hold the place: definitions, then narrow ones, then by name."""
    files = facts["files"].where(contains_ascii_folded(F.col("path"), file)).select(F.col("id").alias("file_id"), "path")
    rows = facts["functions"].where((F.col("line_start") <= line) & (F.col("line_end") >= line) & has_location(F.col("line_start"))).join(files, "file_id")
    return _ranked(rows).select("id", "name", "path", "line_start", "line_end", "is_defined")


def functions_by_name(facts: FactSet, name: str, file: str | None = None) -> DataFrame:
    """Functions of that name or qualified suffix, ranked alike (Q4, O3)."""
    rows = facts["functions"].where(names_function(F.col("name"), name)).join(facts["files"].select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    if file:
        rows = rows.where(contains_ascii_folded(F.col("path"), file) & has_location(F.col("line_start")))
    return _ranked(rows).select("id", "name", "path", "line_start", "line_end", "is_defined")


class Ambiguous(ValueError):
    """A name or place doesn't lead to one function."""


def resolve_function(facts: FactSet, target: str) -> int:
    """The id that a name or FILE:LINE stands for; raises if there is none, or several without one sole definition."""
    file, _, line = target.rpartition(":")
    by_place = bool(file) and not file.endswith(":") and line.isdigit()
    found = (functions_at(facts, file, int(line)) if by_place else functions_by_name(facts, target)).limit(64).collect()
    if by_place and not found:
        near = nearest_functions(facts, file, int(line), 3).collect()
        raise Ambiguous(f"no function at {target}; nearest: {', '.join(r.name for r in near) or 'none'}")
    if by_place:
        return found[0].id
    defined = [r for r in found if r.is_defined]
    if len(found) == 1 or len(defined) == 1:
        return (defined or found)[0].id
    raise Ambiguous(f"{target}: {len(found)} functions match")


def nearest_functions(facts: FactSet, file: str, line: int, k: int = 3) -> DataFrame:
    """The k functions of matching files that begin or end nearest to the line."""
    files = facts["files"].where(contains_ascii_folded(F.col("path"), file)).select(F.col("id").alias("file_id"), "path")
    rows = facts["functions"].where(has_location(F.col("line_start"))).join(files, "file_id")
    distance = F.least(F.abs(F.col("line_start") - line), F.abs(F.col("line_end") - line))
    return rows.select("id", "name", "path", distance.alias("distance")).orderBy("distance", "name", "id").limit(k)


def function_catalogue(facts: FactSet) -> DataFrame:
    """Functions with path and link target."""
    targets = facts["functions"].where("target_id is not null").select("target_id").distinct().select("target_id", F.concat(F.lit("target"), "target_id").alias("target"))
    return facts["functions"].join(facts["files"].select(F.col("id").alias("file_id"), "path"), "file_id").join(targets, "target_id", "left").select("id", "name", "path", "target")


def function_labels(facts: FactSet) -> DataFrame:
    """Display labels: name with [external] where there is no body, else with file:line (Q34)."""
    rows = facts["functions"].join(facts["files"].select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    base = F.element_at(F.split("path", r"[/\\]"), -1)
    place = F.concat(F.col("name"), F.lit(" ("), base, F.lit(":"), F.col("line_start"), F.lit(")"))
    return rows.select("id", F.when(F.col("is_defined") == 0, F.concat("name", F.lit(" [external]"))).when(has_location(F.col("line_start")), place).otherwise(F.col("name")).alias("label"))


# Variables and their nodes.


def symbols_at(facts: FactSet, file: str, line: int, col: int, spread: int = 2) -> DataFrame:
    """Variables near a place, exact hits first."""
    files = facts["files"].where(contains_ascii_folded(F.col("path"), file)).select(F.col("id").alias("file_id"), "path")
    rows = facts["variables"].where((F.col("is_synthetic") == 0) & F.col("line").between(line - spread, line + spread)).join(files, "file_id")
    hit = (F.col("line") == line) & (F.col("col") <= col) & (F.lit(col) < F.col("col") + F.length("name"))
    off = F.abs(F.col("col") - col)
    rank = F.when(hit, F.lit(0)).otherwise(F.abs(F.col("line") - line) + 1)
    return rows.select("id", "name", "path", "line", "col", rank.cast("long").alias("rank"), off.cast("long").alias("off")).orderBy("rank", "off", "col", "path", "line", "id")


def parameter_twins(facts: FactSet) -> DataFrame:
    """Pairs of parameters of one function with one name."""
    p = facts["variables"].where("kind = 'param' and fn_id is not null and name is not null").select("id", F.struct("fn_id", "name").alias("of"))
    return block_join(p, p.withColumnRenamed("id", "twin"), "of", "id", "twin").where("id <> twin").select("id", "twin")


def touched_nodes(facts: FactSet) -> DataFrame:
    """Nodes at either end of a flow edge."""
    e = facts["flow_edges"]
    return e.select(F.col("src_node").alias("id")).unionByName(e.select(F.col("dst_node").alias("id"))).distinct()


def flow_nodes_of(facts: FactSet, variables: DataFrame) -> DataFrame:
    """Start nodes (id) of variables (id); parameter twins are added only if no start touches an edge (Q9)."""
    nodes = facts["flow_nodes"].where("var_id is not null").select("id", "var_id")
    own = nodes.join(variables.select(F.col("id").alias("var_id")), "var_id", "left_semi").select("id")
    live = own.join(touched_nodes(facts), "id", "left_semi").limit(1).select(F.lit(1).alias("live"))
    wide = parameter_twins(facts).join(variables.select("id"), "id", "left_semi").select(F.col("twin").alias("var_id"))
    more = nodes.join(wide, "var_id", "left_semi").select("id")
    more = more.join(F.broadcast(live), F.lit(True), "left_anti")
    return own.unionByName(more).distinct()


def node_labels(facts: FactSet) -> DataFrame:
    """Label and detail of flow nodes; a variable's node without its own gets them from the variable and its function."""
    v = facts["variables"].select(F.col("id").alias("var_id"), F.col("name").alias("var_name"), F.col("kind").alias("var_kind"), F.col("line").alias("var_line"), F.col("fn_id").alias("var_fn"))
    f = facts["functions"].select(F.col("id").alias("owner"), F.col("name").alias("fn_name"))
    rows = facts.require("flow_nodes").join(v, "var_id", "left").withColumn("owner", F.coalesce("fn_id", "var_fn")).join(f, "owner", "left")
    bare = lambda c: (F.col("kind") == "var") & (F.coalesce(F.col(c), F.lit("")) == "")
    name = F.coalesce("var_name", F.concat(F.lit("var"), F.coalesce("var_id", "id")))
    where = F.concat("var_kind", F.lit(" @"), "var_line", F.coalesce(F.concat(F.lit(" in "), "fn_name"), F.lit("")))
    return rows.select("id", "kind", F.when(bare("label"), name).otherwise(F.col("label")).alias("label"), F.when(bare("detail"), F.coalesce(where, F.lit(""))).otherwise(F.col("detail")).alias("detail"))


# Unresolved calls.


def unresolved_sites(facts: FactSet) -> DataFrame:
    """Sites without an edge."""
    return facts["call_sites"].join(facts["call_edges"].select(F.col("call_site_id").alias("id")), "id", "left_anti")


def unresolved_leaves(facts: FactSet) -> DataFrame:
    """One leaf for sites of a caller that read and stand alike; the lowest site id, negated, is its node."""
    return leaves_of(unresolved_sites(facts), facts["files"])


def leaves_of(sites: DataFrame, files: DataFrame) -> DataFrame:
    """unresolved_leaves() of sites that have no edge."""
    rows = sites.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return rows.groupBy("caller_fn_id", "callee_text", "path", "line", "col").agg((-F.min("id") - 1).alias("node"))


# The innermost definition around a line.


def innermost(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """places (file_id, line) with owner: the definition that holds the line most narrowly, or null.

    ranges has id, file_id, line_start, line_end. A sole holder owns all its lines. Among several, the one
    with the latest start, then earliest end, owns the line if all others enclose it and the line lies
    strictly inside it; twins with equal lines own nothing.
    """
    places = places.select("file_id", "line").distinct()
    # a range lies in at most two cells of the least width 2^level that holds it, so places look into one cell of each level
    spans = ranges.select("id", "file_id", "line_start", "line_end").where("line_start <= line_end")
    spans = spans.withColumn("level", F.ceil(F.log2(F.col("line_end") - F.col("line_start") + 1)).cast("int"))
    cell = lambda line, level: F.floor(F.col(line) / F.pow(F.lit(2.0), level)).cast("long")
    cells = F.array_distinct(F.array(cell("line_start", F.col("level")), cell("line_end", F.col("level"))))
    spans = spans.withColumn("cell", F.explode(cells))
    levels = F.broadcast(spans.select("level").distinct())  # as many as a line's number has bits at most
    at = places.crossJoin(levels).withColumn("cell", cell("line", F.col("level")))
    held = at.join(spans, ["file_id", "level", "cell"]).where("line between line_start and line_end").drop("level", "cell")
    by = W.partitionBy("file_id", "line")
    order = by.orderBy(F.col("line_start").desc(), "line_end", "id")
    rows = held.select("*", F.row_number().over(order).alias("rn"), F.count("*").over(by).alias("k"), F.min("line_end").over(by).alias("least_end"), F.count("*").over(W.partitionBy("file_id", "line", "line_start", "line_end")).alias("twins"))
    inside = (F.col("line") > F.col("line_start")) & (F.col("line") < F.col("line_end"))
    owner = F.when((F.col("k") == 1) | ((F.col("twins") == 1) & inside & (F.col("least_end") == F.col("line_end"))), F.col("id"))
    top = rows.where("rn = 1").select("file_id", "line", owner.alias("owner"))
    return places.join(top, ["file_id", "line"], "left")


def unique_or_null(rows: DataFrame, by: list[str], id_col: str, name_col: str, out: str) -> DataFrame:
    """The group's name if all its ids are one, else null (A2)."""
    return rows.groupBy(*by).agg(F.when(F.countDistinct(id_col) == 1, F.min(name_col)).alias(out))


# Aggregates.


def resolution_counts(facts: FactSet) -> DataFrame:
    """Edges by resolution; ambiguous ones count as direct (A5)."""
    kind = F.when(F.col("resolution") == "ambiguous", "direct").otherwise(F.col("resolution"))
    return facts["call_edges"].groupBy(kind.alias("resolution")).agg(F.count("*").alias("edges"))


def unify_contexts(contexts: DataFrame, by: list[str]) -> DataFrame:
    """One row for contexts alike in by: concurrent if any is, the strongest evidence of several instances."""
    strength = F.when(F.col("multi_instance") == "loop", 4).when(F.col("multi_instance") == "cycle", 3).when(F.col("multi_instance") == "parent", 2).when(F.col("multi_instance") == "unknown", 1).otherwise(0)
    return contexts.groupBy(*by).agg(F.max("self_concurrent").alias("self_concurrent"), F.max_by("multi_instance", strength).alias("multi_instance"))


def unresolved_externals(facts: FactSet, k: int = 10) -> DataFrame:
    """The k callee names most often left external."""
    f = facts["functions"].select(F.col("id").alias("callee_fn_id"), "name")
    rows = facts["call_edges"].where("resolution = 'external'").join(f, "callee_fn_id")
    return rows.groupBy("name").agg(F.count("*").alias("calls")).orderBy(F.col("calls").desc(), "name").limit(k)


def totals(facts: FactSet, names: list[str]) -> DataFrame:
    """Row counts by relation (A1, A10)."""
    out = None
    for n in names:
        one = facts[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def next_id(df: DataFrame, column: str = "id") -> DataFrame:
    """The id after the largest; 1 for an empty table (A3)."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def size_statistics(sizes: DataFrame, column: str) -> DataFrame:
    """Number, least, middle and largest of a column of sizes."""
    return sizes.agg(F.count("*").alias("n"), F.min(column).alias("least"), F.expr(f"percentile_disc(0.5) within group (order by {column})").alias("middle"), F.max(column).alias("most"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two bags differ, with their side (U4)."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def sites_at(facts: FactSet, file: str, line: int) -> DataFrame:
    """Sites spelled or expanded at a line."""
    files = facts["files"].where(contains_ascii_folded(F.col("path"), file)).select(F.col("id").alias("f"))
    s = facts["call_sites"]
    spelled = s.where(F.col("line") == line).join(files, F.col("file_id") == F.col("f"), "left_semi").select("id")
    expanded = s.where(F.col("expansion_line") == line).join(files, F.col("expansion_file_id") == F.col("f"), "left_semi").select("id")
    return spelled.union(expanded).distinct()


def edges_with_origins(facts: FactSet) -> DataFrame:
    """Flow edges with every recorded origin, and without one where none is."""
    return facts["flow_edges"].join(facts["flow_origins"], ["src_node", "dst_node", "kind"], "left")


def operation_names(edges: DataFrame) -> DataFrame:
    """What a flow edge does, in words (Q15)."""
    words = {"copy": "assign", "addr_of": "take address", "load": "read", "store": "write", "gep": "select field", "call_arg": "pass"}
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return edges.withColumn("operation", F.coalesce(F.element_at(table, F.col("kind")), F.col("kind")))


def indirect_return_callees(facts: FactSet) -> DataFrame:
    """Distinct callees of indirect sites."""
    s = facts["call_sites"].where("is_direct = 0").select(F.col("id").alias("call_site_id"))
    return facts["call_edges"].join(s, "call_site_id").select("call_site_id", "callee_fn_id").distinct()


def without_noise(sites: DataFrame, patterns: list[str]) -> DataFrame:
    """Call sites whose text matches none of the noise patterns."""
    return sites.where(~matches_any(F.col("callee_text"), patterns)) if patterns else sites


def coverage(arms: DataFrame) -> DataFrame:
    """Rows path, arms, taken, share in whole percent (X12). arms: path, taken (0 or 1)."""
    return arms.groupBy("path").agg(F.count("*").alias("arms"), F.sum("taken").alias("taken")).withColumn("percent", F.floor(100 * F.col("taken") / F.col("arms")))
