"""Runs: models are computed from frozen inputs, checked, and published at once."""

from .lifecycle import RunResult, Runner
from .store import Store

__all__ = ["RunResult", "Runner", "Store"]
