"""All queries: importing this module registers them."""

from graphloom.plans import cluster_queries, evaluation_queries, fact_queries, file_queries, graph_queries, import_queries, lab_queries, order_queries, place_queries, retrieval_queries, text_queries  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
