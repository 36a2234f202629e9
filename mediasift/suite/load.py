"""Imports every query module, which fills the registry."""

from . import q_contracts, q_jobs, q_scalars, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
