"""Every registered query of the fact operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers fn(spark, sf_dir) under the name; oracle is DuckDB SQL for the same rows."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def facts_query(name: str, select: str | None = None, *relations: str, recursive: bool = False) -> Callable:
    """Registers fn(facts) over the adapted driver tables; select is its SQL over the same relations."""
    from factloom.sources.facts import adapt, with_facts

    def add(fn: Callable) -> Callable:
        query(name, with_facts(select, *relations, recursive=recursive) if select else None)(lambda spark, sf_dir: fn(adapt(spark, sf_dir)))
        return fn

    return add


from factloom.plans import catalogue  # noqa: E402, F401  fills the tables above
