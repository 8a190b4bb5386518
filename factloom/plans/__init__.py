"""Registered queries, grouped by the operators they exercise."""

from importlib import import_module

MODULES = ("views", "text_queries", "fact_queries", "step_queries", "join_queries", "mart_queries", "graph_queries", "rule_queries", "stream_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"factloom.plans.{name}")
