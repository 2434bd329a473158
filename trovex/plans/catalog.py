"""Every registered query of the library, with its SQL where SQL can express it."""

from __future__ import annotations

from . import evaluation, io, lookups, search, streams, text, training  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
