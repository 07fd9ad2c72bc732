"""Queries by name, each with its SQL."""

from __future__ import annotations

from corpusloom.plans import answers, base, derived, documents, graphs, kept, media, pieces, records, repairs, rules, scalars, similarity, small, stages  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracles() -> dict:
    return dict(base.ORACLES)
