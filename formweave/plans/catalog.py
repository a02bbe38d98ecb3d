"""All queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import choosing, cleaning, options, placing, resolving
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "choosing", "cleaning", "options", "placing", "resolving"]
