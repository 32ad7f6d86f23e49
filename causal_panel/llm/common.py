"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causal_panel.sources.scratch import scratch, settle  # noqa: F401  (re-used by the operators)

#: A word: a run of anything but ASCII white space. Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, so that reruns and lost tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(1 << 53)


def spare_name(df: DataFrame, name: str) -> str:
    """A name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], schema: str, rows: int = 1 << 15) -> DataFrame:
    """`work` over tables of whole groups: all rows of a `key` (long) stand together in one call, which gets many keys at once.

    A call gets about `rows` rows; only a single larger key makes it larger. Rows reach a task sorted by key, so a task holds no more than one call.
    """

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            keys = table[key].to_numpy()
            cut = int(np.searchsorted(keys == keys[-1], True))  # where the last key begins
            if cut:
                yield from work(table.slice(0, cut)).to_batches()
                held, n = table.slice(cut).to_batches(), n - cut
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
