"""Named queries. Importing the package registers all of them."""

from importlib import import_module

from loomgraph.plans.registry import QUERIES, callables, oracles

MODULES = ["tables", "edge_queries", "scalar_queries", "connection_queries", "report_queries", "search_queries", "extract_queries", "store_queries"]
for _name in MODULES:
    import_module(f"loomgraph.plans.{_name}")

