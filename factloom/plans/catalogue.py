"""Imports every module that registers queries."""

from factloom.plans import flows, graphs, merges, more, relational, solving, sources  # noqa: F401
