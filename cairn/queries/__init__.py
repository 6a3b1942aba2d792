"""The registered queries, by area. Importing this package fills the registry."""

from cairn.queries import changes, discourse, evaluation, evidence, graph, invalidation, ledgers, maintenance, memory, names, overview, retain, retrieval, rules, sources, temporal  # noqa: F401
from cairn.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
