"""The engine's queries and their SQL."""

from __future__ import annotations

from terrafold.plans import curves as _curves  # noqa: F401  registers its queries
from terrafold.plans import evidence as _evidence  # noqa: F401
from terrafold.plans import objects as _objects  # noqa: F401
from terrafold.plans import surface as _surface  # noqa: F401
from terrafold.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
