"""Drift-tolerant reads, nested JSON to rows, registers and first usable columns."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, required: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Keep the wanted columns, make missing ones, coerce numbers (bad text becomes the default).

    Numeric columns default to 0 unless `defaults` says otherwise; rows without a required key go.
    """
    defaults = defaults or {}
    outs = []
    for field in schema.fields:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.StringType):
            value = F.col(f"`{field.name}`").cast("string")
        else:
            text = F.col(f"`{field.name}`").cast("string")
            # whole numbers may be written as 3.0
            value = text.try_cast("double").cast(field.dataType) if isinstance(field.dataType, T.IntegralType) else text.try_cast(field.dataType)
        if field.name not in required:
            fill = defaults.get(field.name, 0 if isinstance(field.dataType, T.NumericType) else None)
            if fill is not None:
                value = F.coalesce(value, F.lit(fill).cast(field.dataType))
        outs.append(value.alias(field.name))
    return df.select(*outs).dropna(subset=list(required))


def read_epochs(
    spark: SparkSession, paths: dict[str, str], schema: T.StructType, required: Sequence[str],
    defaults: dict[str, object] | None = None, encoding: str = "ISO-8859-1",
) -> DataFrame:
    """One CSV source per epoch, each with its own header, united under one schema with `season`."""
    out = None
    for season, path in paths.items():
        raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
        part = conform(raw, schema, required, defaults).withColumn("season", F.lit(season))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no epochs given")
    return out


def unite(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a frame is null there."""
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def explode_path(df: DataFrame, path: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Follow nested arrays of structs to rows: each step adds its struct as a column of that name.

    A missing or empty array keeps its parent row with nulls.
    """
    out, parent = df, None
    for step in path:
        source = F.col(step) if parent is None else F.col(parent)[step]
        out = out.withColumn(f"_{step}", F.explode_outer(source))
        parent = f"_{step}"
    return out.select(*keep, *[F.col(f"_{step}").alias(step.rstrip("s") if step.endswith("s") else step) for step in path])


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(F.col(column), schema))


def register(df: DataFrame, key: str, values: Sequence[str], order: Column) -> DataFrame:
    """One row per numeric key: rows with nulls or a non-numeric key go, the last by order wins."""
    clean = df.dropna(subset=[key, *values]).withColumn("_key", F.col(key).cast("string").try_cast("bigint"))
    last = F.max_by(F.struct(*values), order)
    return clean.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias(key)).agg(last.alias("_v")).select(key, "_v.*")


def first_available(df: DataFrame, columns: Sequence[str], out: str, forbidden: Sequence[str] = ()) -> DataFrame:
    """The first listed column that exists and has any number in it, as `out`.

    One aggregate over the data decides; forbidden names are refused before anything runs.
    """
    bad = [c for c in columns if c in forbidden]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    present = [c for c in columns if c in df.columns]
    if not present:
        raise KeyError(f"none of the columns exist: {list(columns)}")

    def number(c):
        return F.col(f"`{c}`").cast("string").try_cast("double")

    counts = df.agg(*[F.count(number(c)).alias(f"c{i}") for i, c in enumerate(present)]).first()
    for i, c in enumerate(present):
        if counts[i]:
            return df.withColumn(out, number(c))
    raise KeyError(f"no usable values in: {list(columns)}")
