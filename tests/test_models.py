"""The built-in models' names, and the callable of std::async behind a launch policy."""

from factloom.operators import models
from tests.test_facts import rows


def test_builtin_models_are_those_of_the_reference(spark):
    got = {tuple(r) for r in models.builtin_models(spark).collect()}
    assert {("realloc", "return_alias", 0, None, None), ("realloc", "return_heap", None, None, None), ("dlvsym", "dlsym", 1, None, None), ("GetProcAddress", "dlsym", 1, None, None)} <= got
    posts = "PostTask PostImmediateTask PostHighPriorityTask PostIdleTask PostSyncTask PostTimingTask PostTaskAtFront".split()
    assert {(f"OHOS::AppExecFwk::EventHandler::{p}", "invoke", 0, None, "serial_task") for p in posts} <= got
    assert {("OHOS::AppExecFwk::EventHandler::ProcessEvent", "entry", None, None, "serial_task"), ("OHOS::IRemoteObject::DeathRecipient::OnRemoteDied", "entry", None, None, "ipc_handler")} <= got


def test_async_runs_its_callable_with_and_without_a_policy(spark):
    calls = spark.createDataFrame([(1, "std::async"), (2, "std::async"), (3, "pthread_create")], "call_site_id long, callee string")
    effects = models.matched(calls, models.builtin_models(spark))
    actuals = spark.createDataFrame([(s, i, 10 * s + i) for s in (1, 2, 3) for i in range(4)], "call_site_id long, arg_index int, node long")
    points_to = spark.createDataFrame([(10 * s + i, 100 * s + i) for s in (1, 2, 3) for i in range(4)], "node long, loc long")
    first = spark.createDataFrame([(1, "std::launch"), (2, "Task")], "call_site_id long, class string")
    assert rows(models.callbacks(effects, actuals, points_to, first), "call_site_id", "callee", "context") == [(1, 101, "thread"), (2, 200, "thread"), (3, 302, "thread")]
    assert len(rows(models.callbacks(effects, actuals, points_to), "callee")) == 5
