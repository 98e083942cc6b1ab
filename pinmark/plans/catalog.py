"""All registered queries."""

from __future__ import annotations

from . import captures, observed, texts, verification
from .registry import ORACLES, QUERIES, Query

_MODULES = (captures, verification, texts, observed)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
