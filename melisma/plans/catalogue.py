"""All queries of the library, the subpackage llm apart."""

from __future__ import annotations

from melisma.plans import functions, notes, records, sources, structure, tokens, windows  # noqa: F401
from melisma.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def twins() -> dict[str, str]:
    return dict(SQL)
