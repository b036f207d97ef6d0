"""All queries by name, with their SQL."""

from sparkloom.plans import ensembling, graphs, learning, oof, pairs, ranking, reading, relational, scoring, sequences  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES  # noqa: F401
