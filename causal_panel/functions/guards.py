"""Checks on declared inputs, made before a plan is built."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

# Realised fields that no forecast may read.
REALISED = frozenset(
    ("points", "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "bps",
     "expected_goals", "expected_assists", "expected_goals_conceded")
)


def leaked(columns: Iterable[str], forbidden: Iterable[str] = REALISED) -> list[str]:
    return sorted(set(forbidden) & set(columns))


def guarded(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], forbidden=REALISED) -> DataFrame:
    """Project keys and declared inputs; refuse realised fields and unknown columns."""
    found = leaked(inputs, forbidden)
    if found:
        raise ValueError(f"realised fields among the inputs: {found}")
    missing = [c for c in [*keys, *inputs] if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*keys, *inputs)
