"""The registered queries and their SQL."""

from . import continuous, grids, inference, protocol, recordings, signals, spectra, streams
from .recordings import rank_by_variation_flags as flagship

MODULES = [signals, inference, spectra, recordings, continuous, grids, protocol, streams]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
