"""Registered queries; importing the package adds those of every module."""

from . import queries
from . import ancestry_queries, catalogue_queries, fragment_queries, lineage_queries, merge_queries, path_queries  # isort: skip

QUERY_MODULES = (queries, lineage_queries, ancestry_queries, merge_queries, catalogue_queries, fragment_queries, path_queries)
