"""Generalised linear fits of every epoch (and stratum) at once, by Newton steps on sums.

The fit of an epoch learns from all earlier epochs, aged by its decay. A step computes, in one pass over the rows, the gradient and the curvature
of every fit that a row belongs to: products are summed inside each task before the shuffle, which carries one row per task and fit. The
systems are small and solved on that table. Rows are laid out once as matrices of an epoch, as long as an Arrow batch. Epochs are never looped over, and the number of passes is fixed.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalars import first_match
from ..sources.scratch import settle

STEPS = 8


@dataclass(frozen=True)
class Glm:
    """One model: `family` is gaussian, poisson (log link) or logistic.

    The penalty on squared slopes stands against the summed loss, or against its weighted mean if `of_mean`. `weight` is a column of the rows.
    """

    name: str
    y: str
    family: str
    penalty: float
    decay: float = 1.0
    weight: str | None = None
    of_mean: bool = False


def _line(z: Sequence[Column]) -> Column:
    total = F.get("_b", 0)
    for i, v in enumerate(z):
        total = total + F.get("_b", i + 1) * v
    return total


def _scaled(xs: Sequence[str | Column]) -> list[Column]:
    return [((F.col(x) if isinstance(x, str) else x).cast("double") - F.get("_mean", i)) / F.get("_scale", i) for i, x in enumerate(xs)]


def predict(xs: Sequence[str | Column], family: str) -> Column:
    """What the fit in `_mean`, `_scale`, `_b` expects of a row; null where there is no fit."""
    line = _line(_scaled(xs))
    return {"gaussian": line, "poisson": F.exp(F.when(line > 30, 30.0).otherwise(line)), "logistic": 1 / (1 + F.exp(-line))}[family]


def _by_model(models: Sequence[Glm], value) -> Column:
    return first_match([(F.col("_model") == m.name, value(m)) for m in models], None)


def _with_later(rows: DataFrame, fits: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows beside the fits that learn from them."""
    return rows.join(fits, scope).where(F.col("epoch") < F.col("_target")) if scope else rows.join(fits, F.col("epoch") < F.col("_target"))


def expanding_glms(rows: DataFrame, xs: Sequence[str], models: Sequence[Glm], epochs: DataFrame, keys: Sequence[str] = (), least: int = 1, steps: int = STEPS) -> DataFrame:
    """(`keys`, epoch, _model, _mean, _scale, _b, _rows): a row per model and per (keys, epoch) of `epochs` with `least` earlier rows or more.

    Features are scaled by their plain mean and spread over the earlier rows. Rows with a null feature or label take no part in a model.
    """
    scope = list(keys)
    k = len(xs) + 1
    cells = [*scope, "epoch"]
    used = rows.where(" and ".join(f"`{x}` is not null" for x in xs))
    loads = {m.name: (F.col(m.weight).cast("double") if m.weight else F.lit(1.0)) for m in models}
    sums = [F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(x).cast("double")).alias(f"_s{i}") for i, x in enumerate(xs)], *[F.sum(F.col(x).cast("double") ** 2).alias(f"_ss{i}") for i, x in enumerate(xs)]]
    for m in models:
        y = F.col(m.y).cast("double")
        sums += [F.sum(F.when(y.isNotNull(), loads[m.name])).alias(f"_w_{m.name}"), F.sum(loads[m.name] * y).alias(f"_y_{m.name}")]
    per_epoch = used.groupBy(*cells).agg(*sums)
    spine = epochs.select(*cells).distinct()
    earlier = _with_later(per_epoch, spine.withColumnRenamed("epoch", "_target"), scope)  # (keys x epochs) rows on both sides
    added = [F.sum(c).alias(c) for c in ("_n", *[f"_{t}{i}" for t in ("s", "ss") for i in range(k - 1)])]
    aged = [F.sum(F.pow(F.lit(m.decay), F.col("_target") - F.col("epoch") - 1) * F.col(f"_{t}_{m.name}")).alias(f"_{t}_{m.name}") for m in models for t in "wy"]
    known = earlier.groupBy(*scope, "_target").agg(*added, *aged).where(F.col("_n") >= least)
    mean = F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(k - 1)])
    spread = [F.sqrt(F.greatest(F.col(f"_ss{i}") / F.col("_n") - F.pow(F.col(f"_s{i}") / F.col("_n"), 2), F.lit(0.0))) for i in range(k - 1)]
    scale = F.array(*[F.when(s > 1e-8, s).otherwise(F.lit(1.0)) for s in spread])
    starts = {"gaussian": lambda r: r, "poisson": lambda r: F.log(F.greatest(r, F.lit(1e-6))), "logistic": lambda r: F.log(F.least(F.greatest(r, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(r, F.lit(1e-6)), F.lit(1 - 1e-6))))}
    begun = F.explode(F.array(*[F.struct(
        F.lit(m.name).alias("_model"), F.col(f"_w_{m.name}").alias("_total"),
        F.array(F.coalesce(starts[m.family](F.col(f"_y_{m.name}") / F.col(f"_w_{m.name}")), F.lit(0.0)), *[F.lit(0.0)] * (k - 1)).alias("_b")) for m in models]))
    state = settle(known.select(*scope, "_target", F.col("_n").alias("_rows"), mean.alias("_mean"), scale.alias("_scale"), begun.alias("_m")).select("*", "_m.*").drop("_m"), "newton-0")

    penalty = np.array([0.0] + [1.0] * (k - 1))
    facts = {m.name: (m.penalty, m.of_mean) for m in models}

    @F.pandas_udf("array<double>")
    def stepped(model: pd.Series, load: pd.Series, b: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for name, w, old, s in zip(model, load, b, sums, strict=True):
            weight, of_mean = facts[name]
            curve = np.zeros((k, k))
            curve[np.triu_indices(k)] = s[: k * (k + 1) // 2]
            curve = curve + np.triu(curve, 1).T
            slope, total = np.array(s[k * (k + 1) // 2 :], float), (w if of_mean else 1.0)
            out.append(old - np.linalg.solve(curve / total + np.diag(weight * penalty) + 1e-12 * np.eye(k), slope / total + weight * penalty * old))
        return pd.Series(out)

    labels = [F.col(m.y).cast("double").alias(f"_y_{m.name}") for m in models]
    plain = used.select(*cells, *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)], *labels, *[loads[m.name].alias(f"_w_{m.name}") for m in models])
    numbers = plain.columns[len(cells):]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for own in table.select(cells).group_by(cells).aggregate([]).to_pylist():
                keep = functools.reduce(pc.and_, [pc.is_null(table[c]) if v is None else pc.equal(table[c], v) for c, v in own.items()])
                part = table.filter(keep)
                flat = np.stack([part[c].to_numpy() for c in numbers]).astype(np.float64)  # a null is nan
                fields = [batch.schema.field(c) for c in cells] + [pa.field("_flat", pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([own[c]], batch.schema.field(c).type) for c in cells] + [pa.array([flat.ravel()], pa.list_(pa.float64()))], schema=pa.schema(fields))

    shape = StructType([*plain.select(*cells).schema.fields, StructField("_flat", ArrayType(DoubleType()))])
    blocks = settle(plain.sortWithinPartitions(*cells).mapInArrow(pack, shape), "newton-rows")  # as many rows as an Arrow batch
    order = {m.name: i for i, m in enumerate(models)}
    families, decays = [m.family for m in models], [m.decay for m in models]
    upper = np.triu_indices(k)

    @F.pandas_udf("array<double>")
    def products(flat: pd.Series, gap: pd.Series, model: pd.Series, mean: pd.Series, scale: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for values, past, name, m, s, weights in zip(flat, gap, model, mean, scale, b, strict=True):
            i, table = order[name], np.asarray(values).reshape(len(numbers), -1)
            y, load = table[k - 1 + i], table[k - 1 + len(order) + i]
            use = ~np.isnan(y) & ~np.isnan(load)
            z = np.vstack([np.ones(use.sum()), (table[: k - 1, use] - m[:, None]) / s[:, None]])
            line = weights @ z
            e = line if families[i] == "gaussian" else np.exp(np.minimum(line, 30)) if families[i] == "poisson" else 1 / (1 + np.exp(-np.minimum(line, 30)))
            c = np.ones_like(e) if families[i] == "gaussian" else e if families[i] == "poisson" else e * (1 - e)
            load = load[use] * decays[i] ** past
            out.append(np.append(((z * (load * c)) @ z.T)[upper], z @ (load * (e - y[use]))))
        return pd.Series(out)

    width = k * (k + 1) // 2 + k
    for step in range(1, steps + 1):
        met = _with_later(blocks, state, scope).select(
            *scope, "_target", "_model", products("_flat", F.col("_target") - F.col("epoch") - 1, "_model", "_mean", "_scale", "_b").alias("_p"))
        found = met.groupBy(*scope, "_target", "_model").agg(F.array(*[F.sum(F.get("_p", i)) for i in range(width)]).alias("_sums"))
        state = state.join(found, [*scope, "_target", "_model"])
        state = settle(state.withColumn("_b", stepped("_model", "_total", "_b", "_sums")).drop("_sums"), f"newton-{step}")
    return state.drop("_total").withColumnRenamed("_target", "epoch")


def fitted(df: DataFrame, fits: DataFrame, name: str, xs: Sequence[str | Column], family: str, outs: dict[str, Sequence[str | Column]] | None = None, keys: Sequence[str] = (), out: str = "value") -> DataFrame:
    """`df` with what the model `name` of its epoch expects of it in `out`, and of other features in `outs`."""
    own = fits.where(F.col("_model") == name).drop("_model", "_rows")
    joined = df.join(own, [*keys, "epoch"], "left")
    return joined.select(*df.columns, *[predict(f, family).alias(o) for o, f in ({out: xs} | (outs or {})).items()])


def glm_sql(train: str, targets: str, xs: Sequence[str], models: Sequence[Glm], steps: int = STEPS, least: int = 1) -> str:
    """CTEs to `fits` (epoch, model, mean, scale, b): the same steps in SQL, from `train` (epoch, features, labels, weights) and `targets` (epoch)."""
    k = len(xs) + 1
    lists = lambda parts: "[" + ", ".join(parts) + "]"
    number = lambda v: f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))
    values = lists([f"CAST({x} AS DOUBLE)" for x in xs])
    laid = " UNION ALL ".join(
        f"SELECT t.epoch AS target, '{m.name}' AS model, pow({number(m.decay)}, t.epoch-r.epoch-1)*{m.weight or '1e0'} AS w, CAST({m.y} AS DOUBLE) AS y, list_transform(x, lambda v, i: (v-mean[i])/scale[i]) AS z FROM {train}_x r JOIN {train}_s t ON r.epoch<t.epoch WHERE {m.y} IS NOT NULL" for m in models)
    family = {m.name: m.family for m in models}
    case = lambda f: "CASE model " + " ".join(f"WHEN '{m.name}' THEN {f(m)}" for m in models) + " END"
    start = case(lambda m: {"gaussian": "r", "poisson": "ln(greatest(r,1e-6))", "logistic": "ln(least(greatest(r,1e-6),1-1e-6)/(1-least(greatest(r,1e-6),1-1e-6)))"}[family[m.name]])
    expected = case(lambda m: {"gaussian": "q", "poisson": "exp(least(q,30))", "logistic": "1/(1+exp(-least(q,30)))"}[family[m.name]])
    curve = case(lambda m: {"gaussian": "1e0", "poisson": "e", "logistic": "e*(1-e)"}[family[m.name]])
    share = case(lambda m: "ld" if m.of_mean else "1e0")
    weight = case(lambda m: number(m.penalty))
    at = lambda i: "1e0" if i == 0 else f"z[{i}]"
    rows = lists([lists([f"sum(w*c*{at(i)}*{at(j)})/any_value(tot)+{'any_value(pen)' if i == j and i else '0'}+{'1e-12' if i == j else '0'}" for j in range(k)] + [f"sum(w*(e-y)*{at(i)})/any_value(tot)+{f'any_value(pen)*any_value(b)[{i + 1}]' if i else '0'}"]) for i in range(k)])
    solve = f"SELECT step, target, model, any_value(b) AS b, any_value(ld) AS ld, {rows} AS m FROM (SELECT *, {curve} AS c FROM (SELECT *, {expected} AS e, {share} AS tot, {weight} AS pen FROM (SELECT s.step, s.target, s.model, s.b, s.ld, w, y, z, b[1]+list_dot_product(z, b[2:]) AS q FROM st s JOIN {train}_z USING (target, model) WHERE step<{steps}))) GROUP BY step, target, model"
    for p in range(1, k + 1):
        solve = f"SELECT step, target, model, b, ld, list_transform(m, lambda r, i: CASE WHEN i={p} THEN list_transform(r, lambda a: a/r[{p}]) ELSE list_transform(r, lambda a, j: a-r[{p}]*m[{p}][j]/m[{p}][{p}]) END) AS m FROM ({solve})"
    return f"""{train}_x AS MATERIALIZED (SELECT *, {values} AS x FROM {train} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in xs)}),
{train}_s AS MATERIALIZED (SELECT t.epoch, {lists([f'avg(x[{i}])' for i in range(1, k)])} AS mean, {lists([f"CASE WHEN sqrt(greatest(avg(x[{i}]*x[{i}])-pow(avg(x[{i}]),2),0))>1e-8 THEN sqrt(greatest(avg(x[{i}]*x[{i}])-pow(avg(x[{i}]),2),0)) ELSE 1 END" for i in range(1, k)])} AS scale FROM {targets} t JOIN {train}_x r ON r.epoch<t.epoch GROUP BY t.epoch HAVING count(*)>={least}),
{train}_z AS MATERIALIZED ({laid}),
st AS (SELECT 0 AS step, target, model, list_concat([{start}], {lists(['0e0'] * (k - 1))}) AS b, ld FROM (SELECT target, model, sum(w*y)/sum(w) AS r, sum(w) AS ld FROM {train}_z GROUP BY ALL)
 UNION ALL SELECT step+1, target, model, list_transform(b, lambda v, i: v-m[i][{k + 1}]) AS b, ld FROM ({solve})),
fits AS (SELECT target AS epoch, model, mean, scale, b FROM st JOIN {train}_s s ON s.epoch=target WHERE step={steps})"""


def predict_sql(xs: Sequence[str], family: str, fit: str = "f") -> str:
    line = f"{fit}.b[1]" + "".join(f"+{fit}.b[{i + 2}]*({x}-{fit}.mean[{i + 1}])/{fit}.scale[{i + 1}]" for i, x in enumerate(xs))
    return {"gaussian": line, "poisson": f"exp(CASE WHEN {line}>30 THEN 30 ELSE {line} END)", "logistic": f"1/(1+exp(-({line})))"}[family]
