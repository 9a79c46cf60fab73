"""Importing this module registers every query."""

from seriesloom.plans import columns, files, fits, links, scores, sequences, states  # noqa: F401
from seriesloom.plans.registry import ORACLES, QUERIES  # noqa: F401
