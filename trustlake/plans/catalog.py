"""Collects the query modules; importing this module fills the registry."""

from trustlake.plans import q_calibration, q_gate, q_models, q_record, q_reports, q_sources, q_streams, q_text, q_trust  # noqa: F401
from trustlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
