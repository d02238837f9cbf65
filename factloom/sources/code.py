"""Readers of source trees and build metadata: one row a file in, fact rows out."""

from __future__ import annotations

import json
import posixpath
import re
import shlex

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Suffixes of sources and headers.
SOURCES = ("c", "cc", "cpp", "cxx")
HEADERS = ("h", "hh", "hpp", "hxx", "inl")
INCLUDE = r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+[>"])'


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows path, text, is_header of a tree's C and C++ files, by suffix (S1). Spark's scans leave out empty files."""
    glob = "*.{" + ",".join((*SOURCES, *HEADERS)) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.col("path")
    suffix = F.lower(F.substring_index(path, ".", -1))
    return rows.select(F.regexp_replace(path, "^file:/+", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), suffix.isin(*HEADERS).alias("is_header"))


def include_edges(files: DataFrame, search: list[str] | None = None) -> DataFrame:
    """Rows src, spelled, dst: what each file includes.

    A quoted name is looked for beside the includer, then in the search folders in order, then by its base name if
    only one file has it; a name in angle brackets isn't looked for beside the includer. dst is null if nothing fits.
    """
    spark = files.sparkSession
    found = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(1))).alias("t")).distinct()
    found = found.select("src", F.expr("substring(t, 2, length(t) - 2)").alias("spelled"), F.col("t").startswith('"').alias("quoted"))
    folder = F.regexp_replace("src", "/[^/]*$", "")
    normal = F.udf(posixpath.normpath, "string")  # one small string a row; there is no built-in for it
    beside = found.where("quoted").select("src", "spelled", normal(F.concat(folder, F.lit("/"), "spelled")).alias("dst"), F.lit(0).alias("rank"))
    dirs = spark.createDataFrame([(d.rstrip("/"), n + 1) for n, d in enumerate(search or [])], "dir string, rank int")
    listed = found.crossJoin(F.broadcast(dirs)).select("src", "spelled", normal(F.concat("dir", F.lit("/"), "spelled")).alias("dst"), "rank")
    known = files.select(F.col("path").alias("dst"))
    base = lambda c: F.substring_index(c, "/", -1)
    sole = known.groupBy(base(F.col("dst")).alias("base")).agg(F.min("dst").alias("dst"), F.count("*").alias("k")).where("k = 1").drop("k")
    by_name = found.withColumn("base", base(F.col("spelled"))).join(sole, "base").select("src", "spelled", "dst", F.lit(1 << 30).alias("rank"))
    tries = beside.unionByName(listed).join(known, "dst", "left_semi").unionByName(by_name)
    best = tries.groupBy("src", "spelled").agg(F.min(F.struct("rank", "dst")).alias("m")).select("src", "spelled", F.col("m.dst").alias("dst"))
    return found.select("src", "spelled").distinct().join(best, ["src", "spelled"], "left")


def missing_headers(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows spelled, includers, candidate: names that nothing fits, and folders from which they would (X11)."""
    lost = includes.where("dst is null").groupBy("spelled").agg(F.countDistinct("src").alias("includers"))
    headers = files.where("is_header").select("path", F.substring_index("path", "/", -1).alias("base"))
    near = lost.withColumn("base", F.substring_index("spelled", "/", -1)).join(headers, "base", "left")
    root = F.when(F.col("path").endswith(F.concat(F.lit("/"), F.col("spelled"))), F.expr("substring(path, 1, length(path) - length(spelled) - 1)"))
    return near.groupBy("spelled", "includers").agg(F.min(root).alias("candidate"))


def split_options(args: list[str], folder: str) -> dict:
    """What matters of a compiler's arguments: include folders, definitions, forced includes, language."""
    out: dict = {"includes": [], "defines": [], "forced": [], "std": None}
    at = 1
    while at < len(args):
        a = args[at]
        for flag, key in (("-I", "includes"), ("-isystem", "includes"), ("-iquote", "includes"), ("-D", "defines"), ("-include", "forced")):
            if a == flag and at + 1 < len(args):
                at += 1
                out[key].append(args[at])
                break
            if a.startswith(flag) and a != flag and (flag in ("-I", "-D") or not a[len(flag) :].startswith("-")):
                if flag == "-I" and a.startswith("-include"):
                    continue
                out[key].append(a[len(flag) :])
                break
        else:
            if a.startswith("-std="):
                out["std"] = a[5:]
        at += 1
    out["includes"] = [posixpath.normpath(posixpath.join(folder, p)) for p in out["includes"]]
    return out


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Rows file, includes, defines, forced, std of a compilation database."""
    text = spark.read.option("wholetext", True).text(path)
    schema = "file string, includes array<string>, defines array<string>, forced array<string>, std string"

    def run(frames):
        for frame in frames:
            rows = []
            for value in frame["value"]:
                for e in json.loads(value):
                    args = e.get("arguments") or shlex.split(e.get("command", ""))
                    folder = e.get("directory", "/")
                    o = split_options(args, folder)
                    rows.append((posixpath.normpath(posixpath.join(folder, e["file"])), o["includes"], o["defines"], o["forced"], o["std"]))
            yield pd.DataFrame(rows, columns=["file", "includes", "defines", "forced", "std"])

    return text.mapInPandas(run, schema)


def link_commands(spark: SparkSession, path: str) -> DataFrame:
    """Rows target, source, dependency of link metadata: [{"output", "sources", "dependencies"}]."""
    schema = "output string, sources array<string>, dependencies array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    own = rows.select(F.col("output").alias("target"), F.explode("sources").alias("source"), F.lit(None).cast("string").alias("dependency"))
    return own.unionByName(rows.select(F.col("output").alias("target"), F.lit(None).cast("string").alias("source"), F.explode("dependencies").alias("dependency")))


_GN = re.compile(r'\b(executable|shared_library|static_library|source_set|ohos_\w+)\s*\(\s*"([^"]+)"\s*\)\s*\{')


def gn_targets(text: str) -> list[tuple[str, str, list[str], list[str]]]:
    """(kind, name, sources, deps) of the targets in a GN file; braces are matched, lists may be set in parts."""
    out = []
    for m in _GN.finditer(text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        body = re.sub(r"#[^\n]*", "", text[m.end() : at])
        lists = {k: [s for part in re.findall(rf"\b{k}\s*\+?=\s*\[([^\]]*)\]", body) for s in re.findall(r'"([^"]*)"', part)] for k in ("sources", "deps")}
        out.append((m[1], m[2], lists["sources"], lists["deps"]))
    return out


def gn_target_rows(files: DataFrame) -> DataFrame:
    """Rows path, kind, name, sources, deps of GN files (path, text)."""

    def run(frames):
        for frame in frames:
            rows = [(p, *t) for p, text in zip(frame["path"], frame["text"], strict=True) for t in gn_targets(text or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "sources", "deps"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, sources array<string>, deps array<string>")


_IDL = re.compile(r"\binterface\s+([\w.:]+)\s*(?:extends\s+[\w.:]+\s*)?\{(.*?)\}", re.S)
_METHOD = re.compile(r"(?:\[[^\]]*\]\s*)?([\w<>\[\]., ]+?)\s+(\w+)\s*\(([^)]*)\)\s*;", re.S)


def idl_interfaces(text: str) -> list[tuple[str, str, str, list[str]]]:
    """(interface, proxy, stub, methods) of the interfaces in an IDL file; comments don't count."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    out = []
    for name, body in _IDL.findall(text):
        *scope, last = re.split(r"\.|::", name)
        core = last[1:] if last[:1] == "I" and last[1:2].isupper() else last
        place = "::".join(scope) + "::" if scope else ""
        out.append((place + last, f"{place}{core}Proxy", f"{place}{core}Stub", [m[1] for m in _METHOD.findall(body)]))
    return out


def idl_rows(files: DataFrame) -> DataFrame:
    """Rows path, interface, proxy, stub, methods of IDL files (path, text)."""

    def run(frames):
        for frame in frames:
            rows = [(p, *t) for p, text in zip(frame["path"], frame["text"], strict=True) for t in idl_interfaces(text or "")]
            yield pd.DataFrame(rows, columns=["path", "interface", "proxy", "stub", "methods"])

    return files.select("path", "text").mapInPandas(run, "path string, interface string, proxy string, stub string, methods array<string>")


def run_option(runs: DataFrame, option: str) -> DataFrame:
    """One row, value: an option in the JSON of the first run."""
    return runs.orderBy("id").limit(1).select(F.get_json_object("options_json", f"$.{option}").alias("value"))


def read_filter(text: str) -> list[str]:
    """Patterns of a display filter: a JSON list, or an object with a list under "patterns" (S17, X3)."""
    found = json.loads(text)
    found = found.get("patterns", []) if isinstance(found, dict) else found
    for p in found:
        re.compile(p)
    return [p.replace("(?P<", "(?<") for p in found]


def union_inputs(tables: list[DataFrame]) -> DataFrame:
    """One relation of several inputs, each row with its input's number."""
    out = None
    for n, df in enumerate(tables):
        own = df.withColumn("db_idx", F.lit(n))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def latest_facts(facts: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of the highest version of each key."""
    w = W.partitionBy(*key)
    return facts.withColumn("__top", F.max(version).over(w)).where(F.col(version) == F.col("__top")).drop("__top")
