"""Fact sets: named relations that describe a code base, their required columns, and where they come from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: Columns that readers may rely on; writers may add more.
COLUMNS = {
    "files": "id path sha256 is_dep",
    "functions": "id name file_id line_start line_end linkage signature is_defined is_dep is_weak target_id",
    "call_sites": "id caller_fn_id file_id line col callee_text is_direct expansion_file_id expansion_line expansion_col",
    "call_edges": "id call_site_id caller_fn_id callee_fn_id resolution",
    "variables": "id name kind fn_id file_id line col is_synthetic",
    "flow_nodes": "id kind label detail var_id fn_id",
    "flow_edges": "src_node dst_node kind",
    "flow_origins": "src_node dst_node kind file_id line",
    "arg_flow_edges": "call_site_id arg_index actual_var actual_fn formal_var",
    "diagnostics": "id stage severity file_id line message",
    "execution_contexts": "id kind entry_fn_id call_site_id api multi_instance self_concurrent",
    "inheritance": "derived base",
    "methods": "class_id name fn_id is_final",
    "includes": "src dst",
    "cfg_blocks": "cfg_id block kind",
    "cfg_edges": "cfg_id src dst",
    "cfg_events": "cfg_id event block ordinal call_site_id",
}


class MissingFacts(ValueError):
    """A relation or column that a query needs isn't there."""


class FactSet(Mapping[str, DataFrame]):
    """Named DataFrames; one immutable snapshot of facts."""

    def __init__(self, relations: Mapping[str, DataFrame]):
        self._relations = dict(relations)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._relations:
            raise MissingFacts(f"no relation {name}; there are {', '.join(sorted(self._relations)) or 'none'}")
        return self._relations[name]

    def __contains__(self, name: object) -> bool:
        return name in set(self)

    def __iter__(self):
        return iter(self._relations)

    def __len__(self) -> int:
        return len(self._relations)

    def require(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The relation, after a check of its columns that says what is missing."""
        df = self[name]
        if missing := [c for c in (columns or COLUMNS.get(name, "").split()) if c not in df.columns]:
            raise MissingFacts(f"relation {name} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
        return df

    def views(self, spark: SparkSession) -> None:
        """Registers every relation as a temporary view, for SQL of one's own."""
        for name, df in self._relations.items():
            df.createOrReplaceTempView(name)

    def with_relation(self, name: str, df: DataFrame) -> FactSet:
        return FactSet({**self._relations, name: df})


def read_facts(spark: SparkSession, path: str, names: Iterable[str] | None = None, strict: bool = True) -> FactSet:
    """A fact set from a folder with one Parquet table a relation; strict checks the columns of all."""
    path = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, old = hadoop.Path(path), hadoop.Path(f"{path}.old")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place) and fs.exists(old):  # a writer died between two renames
        path = f"{path}.old"
    found = FactSet({n: spark.read.parquet(f"{path}/{n}") for n in (names or COLUMNS)})
    if strict:
        for n in found:
            found.require(n)
    return found


def from_rows(spark: SparkSession, **tables: tuple[str, list]) -> FactSet:
    """A fact set from literal rows: name=(schema text, rows)."""
    return FactSet({n: spark.createDataFrame(rows, schema) for n, (schema, rows) in tables.items()})


#: The relations made of the driver's tables: one text for Spark SQL and DuckDB, other relations in braces. Every row of a table takes
#: part. Calls fan out threefold from function to function; values flow within groups of twelve nodes, and from group to group by arguments.
ADAPTER = {
    "files": """select cast(n_nationkey as bigint) id, '/proj/' || lower(replace(n_name, ' ', '_')) || '.c' path, '' sha256,
        case when n_regionkey = 4 then 1 else 0 end is_dep from {nation}""",
    "functions": """select p_partkey id,
        case p_partkey % 3 when 0 then 'f' || cast(p_partkey % 50 as string) when 1 then 'ns::f' || cast(p_partkey % 50 as string) else 'ns::C::f' || cast(p_partkey % 50 as string) end name,
        p_partkey % 25 file_id, case when p_partkey % 13 = 0 then 0 else cast(floor(p_partkey / 25) as bigint) * 4 + 1 end line_start,
        case when p_partkey % 13 = 0 then 0 else cast(floor(p_partkey / 25) as bigint) * 4 + 1 + p_size % 9 end line_end,
        case when p_partkey % 17 = 0 then 'internal' else 'external' end linkage, 'sig' || cast(p_size % 3 as string) signature,
        case when p_partkey % 13 = 0 or p_partkey % 7 = 0 then 0 else 1 end is_defined, case when p_partkey % 25 % 5 = 4 then 1 else 0 end is_dep,
        case when p_partkey % 11 = 0 then 1 else 0 end is_weak, case when p_partkey % 19 = 0 then cast(null as bigint) else p_partkey % 3 end target_id from {part}""",
    "raw_sites": """select l_orderkey * 8 + l_linenumber id, min(l_partkey) caller_fn_id, min(l_suppkey) s, min(l_linenumber) n, min(l_returnflag) r
        from {lineitem} group by l_orderkey, l_linenumber""",
    "call_sites": """select id, caller_fn_id, caller_fn_id % 25 file_id, s + 1 line, cast(n * 4 as bigint) col, 'f' || cast(s % 40 as string) callee_text,
        case when r = 'N' then 0 else 1 end is_direct, case when s % 5 = 0 then caller_fn_id % 25 when s % 7 = 0 then (caller_fn_id + 1) % 25 end expansion_file_id,
        case when s % 5 = 0 or s % 7 = 0 then s + 3 end expansion_line, case when s % 5 = 0 or s % 7 = 0 then cast(1 as bigint) end expansion_col from {raw_sites}""",
    "call_edges": """select id * 2 id, id call_site_id, caller_fn_id, (caller_fn_id * 3 + 1 + (s * 17 + id) % 3) % (select count(*) from {part}) callee_fn_id,
        case when r <> 'N' then (case when id % 9 = 1 then 'ambiguous' when id % 9 = 2 then 'external' else 'direct' end) else 'indirect' end resolution from {raw_sites} where not (r = 'N' and id % 2 = 0)
        union all select s_suppkey * 2 + 1, cast(null as bigint), s_suppkey, (s_suppkey * 7 + 3) % (select count(*) from {part}), 'ipc' from {supplier} where s_suppkey % 5 = 0""",
    "variables": """select c_custkey id, 'v' || cast(c_custkey % 60 as string) name, case c_custkey % 4 when 0 then 'global' when 1 then 'local' when 2 then 'param' else 'file_static' end kind,
        case when c_custkey % 4 = 0 then cast(null as bigint) else c_custkey % 40 end fn_id, cast(c_nationkey as bigint) file_id, 1 + c_custkey % 40 line, 1 + c_custkey % 17 col,
        case when c_custkey % 23 = 0 then 1 else 0 end is_synthetic from {customer}""",
    "flow_nodes": """select o_orderkey id, case o_orderkey % 5 when 0 then 'loc' when 1 then 'call_target' else 'var' end kind,
        case when o_orderkey % 5 = 0 then 'cell ' || cast(o_orderkey as string) when o_orderkey % 5 = 1 then cast(null as string) when o_orderkey % 7 = 3 then '' else 'v' || cast(o_custkey % 60 as string) end label,
        case when o_orderkey % 5 = 0 then (case o_orderkey % 8 when 0 then 'local' when 1 then 'field' when 2 then 'global' when 3 then 'function' when 4 then 'string_lit' when 5 then 'fn_static' else 'heap' end) when o_orderkey % 9 = 2 then cast(null as string) when o_orderkey % 9 = 4 then 'noted' else '' end detail,
        case when o_orderkey % 5 > 1 then o_custkey end var_id, case when o_orderkey % 5 = 1 then o_custkey % 40 end fn_id from {orders}""",
    "flow_edges": """select distinct l_orderkey src_node, case when l_linenumber = 7 then l_orderkey * 7 + l_partkey else l_orderkey - l_orderkey % 12 + (l_orderkey * 7 + l_partkey) % 12 end % (select count(*) from {orders}) dst_node,
        case l_linenumber when 1 then 'copy' when 2 then 'load' when 3 then 'store' when 4 then 'gep' when 5 then 'addr_of' else 'call_arg' end kind from {lineitem}""",
    "flow_origins": """select l_orderkey src_node, case when l_linenumber = 7 then l_orderkey * 7 + l_partkey else l_orderkey - l_orderkey % 12 + (l_orderkey * 7 + l_partkey) % 12 end % (select count(*) from {orders}) dst_node,
        case l_linenumber when 1 then 'copy' when 2 then 'load' when 3 then 'store' when 4 then 'gep' when 5 then 'addr_of' else 'call_arg' end kind,
        l_partkey % 25 file_id, l_suppkey + 1 line from {lineitem}""",
    "arg_flow_edges": """select id call_site_id, n arg_index, case when s % 3 = 0 then cast(null as bigint) else s end actual_var, case when s % 3 = 0 then caller_fn_id end actual_fn, caller_fn_id % 100 formal_var
        from {raw_sites}""",
    "diagnostics": """select event_id id, case event_id % 3 when 0 then 'parse' when 1 then 'link' else 'solve' end stage, case event_id % 4 when 0 then 'error' else 'warning' end severity,
        case when event_id % 10 = 0 then cast(null as bigint) else event_id % 25 end file_id, event_id % 90 + 1 line, event_type message from {events}""",
    "execution_contexts": """select s_suppkey id, case s_suppkey % 4 when 0 then 'thread' when 1 then 'task' when 2 then 'ipc' else 'timer' end kind, (s_suppkey * 13) % (select count(*) from {part}) entry_fn_id,
        case when s_suppkey % 3 = 0 then cast(null as bigint) else s_suppkey * 8 end call_site_id, 'api' || cast(s_suppkey % 6 as string) api,
        case s_suppkey % 5 when 0 then 'loop' when 1 then 'cycle' when 2 then 'parent' when 3 then 'unknown' end multi_instance, case when s_suppkey % 4 = 1 then 1 else 0 end self_concurrent from {supplier}""",
    "inheritance": """select p_partkey derived, cast(floor(p_partkey / 3) as bigint) base from {part} where p_partkey > 0 and p_partkey % 4 <> 1
        union all select cast(2 as bigint), cast(40 as bigint)""",
    "methods": """select p_partkey class_id, 'm' || cast(p_size % 4 as string) name, p_partkey * 3 + 1 fn_id, case when p_partkey % 29 = 0 then 1 else 0 end is_final from {part} where p_partkey % 3 <> 2""",
    "includes": """select cast(n_nationkey as bigint) src, cast((n_nationkey * 3 + 1) % 25 as bigint) dst from {nation} where n_nationkey % 4 <> 3
        union select cast(n_nationkey as bigint), cast(floor(n_nationkey / 2) as bigint) from {nation} where n_nationkey > 0""",
}
BASE = "region nation customer supplier part orders lineitem events".split()


#: Bytes of input (compressed columns) for which a shuffle has one more partition.
BYTES_A_PART = 4 << 20


def _length(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def deal(spark: SparkSession, size: int) -> None:
    """Lets shuffles begin with partitions as many as the input's bytes need, so a task's share doesn't grow with the input; AQE joins small ones."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-size // BYTES_A_PART))))


class AdaptedFacts(FactSet):
    """The relations of ADAPTER over a folder of the driver's tables; each is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__({})
        self._spark, self._sf_dir, self._bytes = spark, sf_dir, 0

    def _made(self, name: str) -> DataFrame:
        if name not in self._relations:
            if name in BASE:
                path = f"{self._sf_dir}/{name}.parquet"
                self._relations[name] = self._spark.read.parquet(path)
                self._bytes += _length(self._spark, path)
                deal(self._spark, self._bytes)
            else:
                text = ADAPTER[name]
                self._relations[name] = self._spark.sql(text, **{t: self._made(t) for t in (*BASE, *ADAPTER) if "{" + t + "}" in text})
        return self._relations[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in ADAPTER or name == "raw_sites":
            raise MissingFacts(f"no relation {name}; there are {', '.join(sorted(self))}")
        return self._made(name)

    def __iter__(self):
        return (n for n in ADAPTER if n != "raw_sites")

    def __len__(self) -> int:
        return len(ADAPTER) - 1

    def with_relation(self, name: str, df: DataFrame) -> FactSet:
        return FactSet({**dict(self), name: df})


def adapt(spark: SparkSession, sf_dir: str) -> FactSet:
    """The facts that ADAPTER makes of the driver's tables, lazily."""
    return AdaptedFacts(spark, sf_dir)


def with_facts(select: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named relations (and what they are made of) as common tables, then the select."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in ADAPTER:
            if "{" + other + "}" in ADAPTER[name]:
                add(other)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    plain = {t: t for t in (*BASE, *ADAPTER)}
    parts = [f"{n} AS MATERIALIZED ({ADAPTER[n].format(**plain)})" for n in wanted]
    text = select.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {text[5:]}"
    return f"WITH {', '.join(parts)} {text}"
