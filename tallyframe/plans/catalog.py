"""All registered queries and oracles (importing the query modules registers them)."""

from tallyframe.plans import q_ingest, q_ledger, q_metrics, q_sequences, q_streams  # noqa: F401
from tallyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
