"""Queries over the driver tables, each with its SQL counterpart where SQL can state it."""

from . import aggregates, frames, matching, quality, scalars, scans, scoring, timeline  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
