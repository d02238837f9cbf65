"""Function models: what calls of known functions do, as constraints on their arguments and results."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.blocks import answers_of

SCHEMA = "name string, effect string, a int, b int, context string"
#: The built-in models as (names, effect, first parameter, second parameter, context).
BUILTIN = [
    ("memcpy memmove strcpy strncpy", "mem_copy", 0, 1, None),
    ("memcpy_s memmove_s strcpy_s strncpy_s strcat_s strncat_s", "mem_copy", 0, 2, None),
    ("memset memset_s", "clears", 0, None, None),
    ("malloc calloc zalloc kmalloc OsalMemAlloc OsalMemCalloc", "return_heap", None, None, None),
    ("realloc", "return_alias", 0, None, None),
    ("realloc", "return_heap", None, None, None),
    ("epoll_ctl", "epoll_register", 3, None, None),
    ("epoll_wait epoll_pwait epoll_pwait2", "epoll_wait", 1, None, None),
    ("dlsym dlvsym GetProcAddress", "dlsym", 1, None, None),
    ("pthread_create OsalTimerCreate", "invoke", 2, 3, "thread"),
    ("HdfWorkInit HdfDelayedWorkInit", "invoke", 1, 2, "serial_task"),
    ("ffrt::submit ffrt::submit_h ffrt_submit_base ffrt_submit_h_base OHOS::ThreadPool::AddTask", "invoke", 0, None, "pool_task"),
    ("ffrt::queue::submit ffrt::queue::submit_h OHOS::Utils::Timer::Register", "invoke", 0, None, "serial_task"),
    ("ffrt_queue_submit ffrt_queue_submit_h", "invoke", 1, None, "serial_task"),
    ("std::thread::thread std::jthread::jthread", "invoke", 0, 1, "thread"),
    ("std::async", "invoke", 0, 1, "thread"),
    ("std::async", "invoke", 1, 2, "thread"),
    (" ".join(f"OHOS::AppExecFwk::EventHandler::Post{m}" for m in ("Task", "ImmediateTask", "HighPriorityTask", "IdleTask", "SyncTask", "TimingTask", "TaskAtFront")), "invoke", 0, None, "serial_task"),
    ("OHOS::Thread::Run", "entry", None, None, "thread"),
    ("OHOS::AppExecFwk::EventHandler::ProcessEvent", "entry", None, None, "serial_task"),
    ("OHOS::IRemoteObject::DeathRecipient::OnRemoteDied", "entry", None, None, "ipc_handler"),
]
#: Names of which an effect counts only as the first argument is a launch policy (its callable comes second) or is none.
POLICY = ("std::async", "std::launch")
#: Effects of which only the exact name counts (also behind :: or std::).
EXACT = ("alias", "mem_copy", "content_store", "epoll_register", "epoll_wait", "clears", "return_alias", "return_heap")
KINDS = (*EXACT, "dlsym", "invoke", "entry", "ipc")


def builtin_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, e, a, b, c) for names, e, a, b, c in BUILTIN for n in names.split()], SCHEMA)


def read_models(spark: SparkSession, text: str) -> DataFrame:
    """Models of a TOML text: [[function]] name, effects = [{kind, a, b, context}]; no effects disable the name."""
    rows = []
    for f in tomllib.loads(text).get("function", []):
        for e in f.get("effects", []):
            if e.get("kind") not in KINDS:
                raise ValueError(f"{f['name']}: unknown effect {e.get('kind')}")
            rows.append((f["name"], e["kind"], e.get("a"), e.get("b"), e.get("context")))
        if not f.get("effects"):
            rows.append((f["name"], None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def overridden(base: DataFrame, *later: DataFrame) -> DataFrame:
    """Later models replace all effects of a name."""
    for more in later:
        base = base.join(more.select("name").distinct(), "name", "left_anti").unionByName(more)
    return base.where("effect is not null")


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, "::"), -1)


def matched(calls: DataFrame, models: DataFrame) -> DataFrame:
    """Calls (call_site_id, callee) with the effects of their model.

    The exact name comes first, then the name without a leading :: or std::; for the effects that go by the member
    (dlsym, invoke, entry, ipc) also a class for its constructor, then the last part of the name. Of the names that
    fit, the first rule's model counts, whole.
    """
    spellings = calls.select("call_site_id", "callee").withColumns({"plain": F.regexp_replace("callee", "^::", ""), "last": _last(F.col("callee"))})
    bare = F.regexp_replace("plain", "^std::", "")
    tries = spellings.select("call_site_id", "callee", F.explode(F.array(
        F.struct(F.lit(0).alias("rule"), F.col("callee").alias("name")), F.struct(F.lit(1).alias("rule"), F.col("plain").alias("name")), F.struct(F.lit(2).alias("rule"), bare.alias("name")),
        F.struct(F.lit(3).alias("rule"), F.concat("callee", F.lit("::"), F.col("last")).alias("name")), F.struct(F.lit(4).alias("rule"), F.col("last").alias("name")))).alias("t"))
    rows = tries.select("call_site_id", "callee", "t.rule", "t.name").join(models, "name").where((F.col("rule") <= 2) | ~F.col("effect").isin(*EXACT))
    w = W.partitionBy("call_site_id", "effect")
    best = rows.withColumn("least", F.min("rule").over(w)).where("rule = least")
    return best.select("call_site_id", "callee", "effect", "a", "b", "context").distinct()


def constraints(effects: DataFrame, actuals: DataFrame, results: DataFrame, has_return: DataFrame) -> DataFrame:
    """Solver constraints (kind, dst, src, field) of modelled calls.

    actuals: call_site_id, arg_index, node; results: call_site_id, node; has_return (call_site_id): calls with a real
    return flow, whose return models do not count. Copies of memory are copies of pointers, as an over-estimate.
    """
    arg = lambda side: actuals.select("call_site_id", F.col("arg_index").alias(side), F.col("node").alias(f"{side}_node"))
    two = effects.where("effect in ('alias', 'mem_copy', 'content_store')").join(arg("a"), ["call_site_id", "a"]).join(arg("b"), ["call_site_id", "b"])
    kind = F.when(F.col("effect") == "content_store", "store").otherwise("copy")
    none = F.lit(None).cast("long").alias("field")
    out = two.select(kind.alias("kind"), F.col("a_node").alias("dst"), F.col("b_node").alias("src"), none)
    ret = effects.where("effect in ('return_alias', 'return_heap', 'dlsym')").join(results.withColumnRenamed("node", "r"), "call_site_id")
    free = ret.join(has_return.select("call_site_id"), "call_site_id", "left_anti")
    alias = free.where("effect = 'return_alias'").join(arg("a"), ["call_site_id", "a"]).select(F.lit("copy").alias("kind"), F.col("r").alias("dst"), F.col("a_node").alias("src"), none)
    heap = free.where("effect = 'return_heap'").select(F.lit("addr_of").alias("kind"), F.col("r").alias("dst"), (-F.col("call_site_id") - 1).alias("src"), none)
    named = ret.where("effect = 'dlsym'").join(arg("a"), ["call_site_id", "a"]).select(F.lit("dlsym").alias("kind"), F.col("r").alias("dst"), F.col("a_node").alias("src"), none)
    return out.unionByName(alias).unionByName(heap).unionByName(named).distinct()


def epoll_copies(effects: DataFrame, actuals: DataFrame) -> DataFrame:
    """Copies from every registered object to every waiting buffer, through one meeting node, so none are paired."""
    hub = F.lit(-(1 << 62)).cast("long")
    arg = actuals.select("call_site_id", F.col("arg_index").alias("a"), "node")
    put = effects.where("effect = 'epoll_register'").join(arg, ["call_site_id", "a"]).select(F.lit("copy").alias("kind"), hub.alias("dst"), F.col("node").alias("src"))
    get = effects.where("effect = 'epoll_wait'").join(arg, ["call_site_id", "a"]).select(F.lit("copy").alias("kind"), F.col("node").alias("dst"), hub.alias("src"))
    return put.unionByName(get).distinct().withColumn("field", F.lit(None).cast("long"))


def launched(effects: DataFrame, first_class: DataFrame) -> DataFrame:
    """Effects without those of std::async that its first argument rules out. first_class: call_site_id, class (of argument 0)."""
    name, policy = POLICY
    is_async = F.col("callee").rlike(f"(^|::){name.rsplit('::', 1)[-1]}$") & (F.col("effect") == "invoke")
    given = first_class.where(F.regexp_replace("class", "^::", "") == policy).select("call_site_id", F.lit(True).alias("policy")).distinct()
    rows = effects.join(given, "call_site_id", "left")
    return rows.where(~is_async | (F.col("a") == F.when(F.col("policy"), 1).otherwise(0))).drop("policy")


def callbacks(effects: DataFrame, actuals: DataFrame, points_to: DataFrame, first_class: DataFrame | None = None) -> DataFrame:
    """Rows call_site_id, callee, context: functions that modelled callees run (F27). points_to: node, loc (functions only).

    first_class as in launched(); without it a callable counts in either place of std::async.
    """
    if first_class is not None:
        effects = launched(effects, first_class)
    arg = actuals.select("call_site_id", F.col("arg_index").alias("a"), "node")
    return effects.where("effect = 'invoke'").join(arg, ["call_site_id", "a"]).join(points_to, "node").select("call_site_id", F.col("loc").alias("callee"), "context").distinct()


def terminators(effects: DataFrame, actuals: DataFrame) -> DataFrame:
    """Rows call_site_id, node: arguments whose memory a call clears."""
    arg = actuals.select("call_site_id", F.col("arg_index").alias("a"), "node")
    return effects.where("effect = 'clears'").join(arg, ["call_site_id", "a"]).select("call_site_id", "node").distinct()


def ipc_bridges(functions: DataFrame, senders: DataFrame) -> DataFrame:
    """Rows proxy_fn, handler_fn: methods of *Proxy or *Client classes that send, and the like-named handlers of the *Stub class.

    functions: id, name, is_defined; senders: id. Constructors and destructors take no part.
    """
    parts = functions.select("id", "is_defined", F.regexp_extract("name", "^(.*)::([^:]+)$", 1).alias("class"), _last(F.col("name")).alias("method")).where("class <> '' and method not like '~%'")
    parts = parts.where(_last(F.col("class")) != F.col("method"))
    proxy = parts.join(senders.select("id"), "id", "left_semi").where(F.col("class").rlike("(Proxy|Client)$")).select(F.col("id").alias("proxy_fn"), "method", F.regexp_replace("class", "(Proxy|Client)$", "Stub").alias("class"))
    stub = parts.where("is_defined = 1").select(F.col("id").alias("handler_fn"), "class", F.regexp_replace("method", "^(Handle|On|Cmd)(?=[A-Z])", "").alias("method"))
    return answers_of(proxy, stub, "proxy_fn", ["class", "method"], "handler_fn").select("proxy_fn", "handler_fn")


def context_evidence(contexts: DataFrame, calls: DataFrame, loops: DataFrame, components: DataFrame) -> DataFrame:
    """Rows id, multi_instance: why a context may have several instances (F32): its site lies in a loop, else its starter on a call cycle, else its starter runs in such a context.

    contexts: id, call_site_id, starter, entry; calls: a, b; loops: call_site_id; components: id, component (of calls).
    """
    from factloom.operators.graph import closure

    sizes = components.groupBy("component").agg(F.count("*").alias("k"))
    selfish = calls.where("a = b").select(F.col("a").alias("starter")).distinct()
    cyclic = components.join(sizes.where("k > 1"), "component").select(F.col("id").alias("starter")).unionByName(selfish).distinct().withColumn("cyclic", F.lit(1))
    rows = contexts.join(loops.select("call_site_id").distinct().withColumn("looped", F.lit(1)), "call_site_id", "left").join(cyclic, "starter", "left")
    own = rows.select("id", "starter", "entry", F.when(F.col("looped") == 1, "loop").when(F.col("cyclic") == 1, "cycle").alias("own"))
    many = own.where("own is not null").select(F.col("entry").alias("id"))
    below = closure(calls.select("a", "b"), many).select(F.col("id").alias("starter")).distinct().withColumn("below", F.lit(1))
    return own.join(below, "starter", "left").select("id", F.coalesce("own", F.when(F.col("below") == 1, "parent")).alias("multi_instance"))
