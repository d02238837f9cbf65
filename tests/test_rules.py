"""Rules of the solver and of the writers, one small case each."""

from factloom.operators import export, merge, models, sequence, solver
from tests.test_facts import rows

C = "kind string, dst long, src long, field long"
L = "loc long, kind string, text string, type_id long"


def test_synced_unwrap_and_named_symbols(spark):
    c = spark.createDataFrame([("addr_of", 1, 500, None), ("unwrap", 2, 1, 7), ("unwrap", 3, 1, 8), ("addr_of", 4, 600, None), ("dlsym", 5, 4, None), ("load", 6, 4, None)], C)
    loc = spark.createDataFrame([(500, "global", None, 7), (600, "literal", "run", None), (801, "function", "run", None)], L)
    synced = spark.createDataFrame([(1, 900)], "node long, cell long")
    got = set(rows(solver.solve(c, loc, synced=synced).facts, "t", "x", "o"))
    assert {("p", 2, 500), ("p", 5, 801), ("m", 900, 500)} <= got and not any(x == 3 for _, x, _ in got) and not any(x == 6 for _, x, _ in got)


def test_functions_and_literals_are_not_stored_into(spark):
    c = spark.createDataFrame([("addr_of", 1, 801, None), ("addr_of", 2, 500, None), ("store", 1, 2, None), ("load", 3, 1, None)], C)
    loc = spark.createDataFrame([(500, "global", None, None), (801, "function", "f", None)], L)
    assert rows(solver.solve(c, loc).facts, "t", "x", "o") == [("p", 1, 801), ("p", 2, 500), ("p", 3, 801)]


def test_a_budget_marks_the_result_partial(spark):
    c = spark.createDataFrame([("addr_of", 0, 9, None)] + [("copy", k + 1, k, None) for k in range(6)], C)
    assert solver.solve(c, max_rounds=2).partial and not solver.solve(c).partial


def test_memory_accesses_fold_beyond_the_cap(spark):
    c = spark.createDataFrame([("load", 1, 10, None), ("store", 11, 2, None), ("load", 3, 12, None)], C)
    f = spark.createDataFrame([("p", 10, 100), ("p", 10, 101), ("p", 10, 102), ("p", 11, 100)], "t string, x long, o long")
    s = spark.createDataFrame([(100, 7), (101, 7), (102, 8)], "cell long, summary long")
    assert rows(solver.memory_accesses(c, f, cap=2, summary=s), "kind", "dst", "cell") == sorted([("load", 1, 7), ("load", 1, 8), ("load", 3, None), ("store", 11, 100)], key=lambda r: (r[0], r[1], r[2] or 0))
    assert {tuple(r) for r in solver.memory_accesses(c, f, cap=2).select("kind", "dst", "cell").collect()} == {("load", 1, None), ("load", 3, None), ("store", 11, 100)}


def test_epoll_objects_reach_every_waiting_buffer(spark):
    e = spark.createDataFrame([(1, "epoll_ctl", "epoll_register", 3), (2, "epoll_wait", "epoll_wait", 1), (3, "memset", "clears", 0)], "call_site_id long, callee string, effect string, a int")
    actuals = spark.createDataFrame([(1, 3, 40), (2, 1, 41), (3, 0, 42)], "call_site_id long, arg_index int, node long")
    c = models.epoll_copies(e, actuals).unionByName(spark.createDataFrame([("addr_of", 40, 777, None)], C))
    assert ("p", 41, 777) in rows(solver.solve(c).facts, "t", "x", "o")
    assert rows(models.terminators(e, actuals), "call_site_id", "node") == [(3, 42)]


def test_bodies_alike_are_kept_once(spark):
    b = spark.createDataFrame([(1, 0, "entry"), (1, 1, "exit"), (2, 0, "entry"), (2, 1, "exit"), (3, 0, "entry")], "cfg_id long, block long, kind string")
    e = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "cfg_id long, src long, dst long")
    owner = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "cfg_id long, fn long")
    assert rows(merge.distinct_bodies(b, e, owner), "fn", "cfg_id", "variant") == [(10, 1, 0), (10, 3, 1)]


def test_layout_is_reverse_postorder():
    order = sequence.Flow([(0, 2), (0, 1), (1, 3), (2, 3), (3, 1)]).layout()
    assert order[0] == 0 and set(order) == {0, 1, 2, 3} and order.index(2) < order.index(3)


def test_flow_graph_of_nothing(spark):
    none = spark.createDataFrame([], "src_node long, dst_node long, kind string")
    assert export.flow_graph(none, none, none, none).count() == 0


def test_events_between_and_documents(spark):
    from factloom.operators import dataflow

    r = spark.createDataFrame([(1, 10, 20, "sequenced_before"), (1, 20, 30, "may_precede"), (1, 10, 30, "guaranteed_before"), (1, 10, 40, "exclusive")], "cfg_id long, a long, b long, relation string")
    assert rows(sequence.between(r, 1, 10, 30), "event") == [(20,)]
    n, e = spark.createDataFrame([(2, "b", 1), (1, "a", 0)], "id long, label string, level int"), spark.createDataFrame([(1, 2, "assign")], "a long, b long, operation string")
    assert dataflow.dataflow_json(n, e).first().document == '{"nodes":[{"id":1,"label":"a","level":0},{"id":2,"label":"b","level":1}],"edges":[{"from":1,"to":2,"operation":"assign"}]}'
