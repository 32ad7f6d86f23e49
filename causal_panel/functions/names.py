"""Keys from free-text names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col

# Latin letters with marks and the plain letters they fold to.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšşťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"


def name_key(name) -> Column:
    """Lower-case, marks folded, everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.translate(F.lower(col(name)), _MARKED, _PLAIN), "[^a-z0-9]", "")


def team_key(name) -> Column:
    """Lower-case, punctuation dropped, hyphens and runs of space as one space."""
    text = F.regexp_replace(F.lower(col(name)), "[.']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "-", " "), r"\s+", " "))


def resolve_alias(df: DataFrame, key: str, aliases: DataFrame, out: str) -> DataFrame:
    """Replace `key` by its alias where one is listed; `aliases` has columns alias, canonical."""
    listed = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = df.join(listed, F.col(key) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_canonical", key)).drop("_alias", "_canonical")
