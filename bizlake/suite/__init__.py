"""One query per operator over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from . import catalogue, columns, exchange, flows, joins, rankings, reports, totals  # noqa: F401
from .base import QUERIES, oracle, run  # noqa: F401
