"""Registered queries and their SQL twins."""

from sightline.plans import decisions, detection, reports, series, streams, tables  # noqa: F401
from sightline.plans.registry import ORACLES, QUERIES  # noqa: F401
