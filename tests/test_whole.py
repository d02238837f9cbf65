"""Queries over whole tables: nothing of the driver's tables is left out, and the answers follow by brute force."""

import pytest
from pyspark.sql import functions as F

from factloom.plans import registry
from factloom.sources.facts import BASE, adapt
from tests.test_facts import rows

EVENTS = [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (45, 1), (46, 2), (91, 61)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small set of the driver's tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    n = lambda k: range(k)
    made = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N {i}", 0) for i in n(25)]),
        "customer": ("c_custkey long, c_nationkey int", [(i, i % 25) for i in n(30)]),
        "supplier": ("s_suppkey long", [(i,) for i in n(10)]),
        "part": ("p_partkey long, p_size int", [(i, i % 50) for i in n(400)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i % 30) for i in n(12)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string", [(i, i * 5 % 11 + k, (i + k) % 10, k, "NA"[i % 2]) for i in n(12) for k in range(1, 8)]),
        "events": ("event_id long, user_id long, event_type string", [(i, u, "t") for i, u in EVENTS]),
    }
    assert set(made) == set(BASE)
    for name, (schema, r) in made.items():
        spark.createDataFrame(r, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_points_to_solves_every_flow_edge(spark, tables):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").collect()
    kinds = {1: "copy", 2: "load", 3: "store", 5: "addr_of"}
    c = {(kinds[r.l_linenumber], (r.l_orderkey * 7 + r.l_partkey) % 12, r.l_orderkey) for r in lines if r.l_linenumber in kinds}
    assert len(c) == 48 and len({r.l_orderkey for r in lines}) == 12
    facts, size = {("p", d, s) for k, d, s in c if k == "addr_of"}, 0
    while size != len(facts):
        size, p, m = len(facts), [f[1:] for f in facts if f[0] == "p"], [f[1:] for f in facts if f[0] == "m"]
        for k, d, s in c:
            if k == "copy":
                facts |= {("p", d, o) for x, o in p if x == s}
            if k == "load":
                facts |= {("p", d, v) for x, o in p if x == s for y, v in m if y == o}
            if k == "store":
                facts |= {("m", o, v) for x, o in p if x == d for y, v in p if y == s}
    assert set(rows(registry.QUERIES["f2_f5_points_to"](spark, tables), "t", "x", "o")) == facts


def test_every_event_is_in_the_graph_of_its_user(spark, tables):
    by: dict = {}
    for event, user in EVENTS:
        by.setdefault(user, []).append(event)
    pairs = sorted((u, a, b) for u, own in by.items() for a in own for b in own if a < b)
    assert rows(registry.QUERIES["q25_event_relations"](spark, tables), "cfg_id", "a", "b") == pairs
    assert {u for u, *_ in rows(registry.QUERIES["q26_dominators"](spark, tables), "cfg_id", "block")} == set(by)
    assert {k for k in rows(registry.QUERIES["q28_combined_relations"](spark, tables), "cfg_id", "k")} == {(u, a % 80) for u, a, _ in pairs}
    assert registry.QUERIES["q31_unordered_runs"](spark, tables).count() == 0
    assert sorted(r.event for r in adapt(spark, tables)["cfg_calls"].collect()) == [e for e, _ in EVENTS]


def test_every_function_context_file_and_binding_takes_part(spark, tables):
    n = 400
    value = {i: {(("call", "var", "heap")[i % 3], (i * 5 + 2) % n if i % 3 == 0 else i + 7)} | ({("call", i * 7 % n)} if i % 10 == 1 else set()) for i in range(n)}
    returned = set()
    for own in value:
        seen, todo = {own}, [own]
        while todo:
            for kind, v in value[todo.pop()]:
                if kind != "call":
                    returned.add((own, kind, v))
                elif v not in seen:
                    seen.add(v)
                    todo.append(v)
    assert set(rows(registry.QUERIES["f14_expanded_returns"](spark, tables), "fn_id", "kind", "value")) == returned and max(r[0] for r in returned) == n - 1
    q = registry.QUERIES
    assert {c for _, c in rows(q["q21_context_sets"](spark, tables), "fn", "context")} >= set(range(1, 11))
    assert any("10" in r.contexts.split(",") for r in q["q22_cross_context"](spark, tables).collect())
    for name, relation in (("q35_index_waves", "inheritance"), ("q35_include_waves", "includes")):
        waves = {r.id: r.wave for r in q[name](spark, tables).collect()}
        edges = {(a, b) for a, b in map(tuple, adapt(spark, tables)[relation].collect()) if a != b}
        assert set(waves) == {n for e in edges for n in e} | (set(range(25)) if relation == "includes" else set())
        assert all(waves[a] is None or waves[b] is not None and waves[b] < waves[a] for a, b in edges)
        assert all((w is None) == (relation == "includes") for w in waves.values())
    ipc = adapt(spark, tables)["call_edges"].where("resolution = 'ipc'").collect()
    assert set(rows(q["m15_rebound_ipc_edges"](spark, tables), "id", "caller_fn_id")) == {(e.id, i) for e in ipc for i in range(n) if i % 10 == e.caller_fn_id}


def test_every_line_is_a_site_and_a_flow_edge(spark, tables):
    lines = {(o, n) for o in range(12) for n in range(1, 8)}
    f, q = adapt(spark, tables), registry.QUERIES
    assert set(rows(f["call_sites"], "id")) == {(o * 8 + n,) for o, n in lines} and f["flow_edges"].select("src_node", "kind").distinct().count() == 12 * 6
    assert f["flow_origins"].count() == len(lines) and f["arg_flow_edges"].count() == len(lines)
    edges = {(o * 8 + n,) for o, n in lines if not (o % 2 == 0 and n % 2 == 0)}  # indirect sites of even ids stay unresolved
    assert set(rows(f["call_edges"].where("call_site_id is not null"), "call_site_id")) == edges
    assert set(rows(q["j4_unresolved_sites"](spark, tables), "id")) == set(rows(f["call_sites"], "id")) - edges
    assert q["q1_calls"](spark, tables).count() == f["call_edges"].count()
