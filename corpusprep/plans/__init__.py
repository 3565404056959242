"""The registered queries; importing this package registers them all."""

from corpusprep.plans import (
    audit, cleaning, listing, packing, records, scoring, sizing, telemetry, tokens,
)
from corpusprep.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "audit", "cleaning", "listing", "packing", "records", "scoring", "sizing",
    "telemetry", "tokens",
]
