"""All registered queries: each module of queries adds its own to the catalogue."""

from tidegraph.plans import network, networks_of_tables, rate_path_queries, samples
from tidegraph.plans.catalogue import ORACLE, QUERIES

MODULES = (network, networks_of_tables, rate_path_queries, samples)
__all__ = ["MODULES", "ORACLE", "QUERIES"]
