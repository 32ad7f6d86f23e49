"""Fingerprints, content-addressed snapshots, feature tables and reports."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import settle


def row_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _hash_aggs(columns: Sequence[str]) -> list[Column]:
    h = row_hash(columns)
    return [
        F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"),
    ]


def fingerprint(df: DataFrame, columns: Sequence[str], tag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tag, row count, and order-free sum and xor of row hashes; a missing column is an error."""
    wanted = list(dict.fromkeys(columns))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"cannot fingerprint missing columns: {missing}")
    out = df.groupBy(*keys).agg(*_hash_aggs(wanted))
    text = F.concat_ws(":", F.lit(tag), F.col("rows"), F.coalesce(F.col("hash_sum"), F.lit(0)).cast("string"), F.coalesce(F.col("hash_xor"), F.lit(0)).cast("string"))
    return out.select(*keys, "rows", text.alias("fingerprint"))


def capture_changes(df: DataFrame, scope: Sequence[str], capture: str, columns: Sequence[str]) -> DataFrame:
    """Whether the rows of a capture differ from those of the capture before it."""
    prints = fingerprint(df, columns, "capture", [*scope, capture])
    last = F.lag("fingerprint").over(Window.partitionBy(*scope).orderBy(capture))
    return prints.withColumn("changed", F.coalesce(F.col("fingerprint") != last, F.lit(False)))


def content_hash(columns: Sequence[str]) -> Column:
    """sha-256 of the row as JSON with its columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`; None if there is no such folder. A damaged table is an error."""
    place, fs = _file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(place) else None


def _entries(spark: SparkSession, path: str) -> list[str]:
    """The folders of the batches that were committed, in order; a line per commit."""
    place, fs = _file_system(spark, f"{path}/log")
    if not fs.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(place))
    found = []
    for name in names:
        if name.isdigit():
            stream = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/{name}"))))
            found.append(stream.readLine())
            stream.close()
    return found


def _claim(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Make `folder` commit `number`, unless another writer has. The file appears whole: it is written aside and then linked or renamed into place."""
    aside, fs = _file_system(spark, f"{path}/log/_{uuid.uuid4().hex}")
    target, _ = _file_system(spark, f"{path}/log/{number:020d}")
    out = fs.create(aside, True)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the other's file
            as_file = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(as_file(target), as_file(aside))
            return True
        return fs.rename(aside, target)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(aside, False)


def append_snapshot(df: DataFrame, path: str, payload: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Append rows named by their content; a row already stored is an error, none is rewritten.

    The input is evaluated once. Duplicates are looked for on the cluster, in the partitions that the rows belong to; only their count comes
    back. The rows go to a folder of their own, which readers don't see until it is entered in the log under the next number. Only one writer
    can take a number: who comes second looks for duplicates in what was entered meanwhile and tries the one after. So writers with overlapping
    batches never store a row twice, and a writer that dies leaves nothing that is read. On an object store without atomic renames, entries
    need a file system that offers them.
    """
    spark = df.sparkSession
    hashed = settle(df.withColumn("content_hash", content_hash(payload)), "snapshot")
    folder = f"{path}/data/batch=b{uuid.uuid4().hex}"
    found = hashed.groupBy("content_hash").count().where("count > 1").count()
    (hashed.write.partitionBy(*partition) if partition else hashed.write).parquet(folder)
    checked = 0
    while not found:
        entries = _entries(spark, path)
        if checked < len(entries):
            known = _batches(spark, path, entries[checked:])
            if partition:
                known = known.join(hashed.select(*partition).distinct(), list(partition), "left_semi")
            found = hashed.join(known.select("content_hash"), "content_hash", "left_semi").count()
            checked = len(entries)
        elif _claim(spark, path, checked, folder):
            return hashed
    place, fs = _file_system(spark, folder)
    fs.delete(place, True)
    raise FileExistsError(f"{found} snapshot rows already exist")


def new_snapshots(df: DataFrame, path: str, payload: Sequence[str]) -> DataFrame:
    """The rows of `df` not yet stored, with their content hash (for idempotent re-runs)."""
    hashed = df.withColumn("content_hash", content_hash(payload)).dropDuplicates(["content_hash"])
    known = read_snapshots(df.sparkSession, path)
    return hashed if known is None else hashed.join(known.select("content_hash"), "content_hash", "left_anti")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """What was appended under `path`; None if nothing was."""
    entries = _entries(spark, path)
    return _batches(spark, path, entries) if entries else None


def _batches(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("batch")


def materialize(df: DataFrame, path: str, tag: str, partition: str, columns: Sequence[str]) -> DataFrame:
    """Write a table by partition, or reuse the one written from the same input under the same tag.

    Input and tag are compared by the fingerprint of `columns`, which names the table's folder. It is noted beside the data once these are
    complete, so a write that broke off is done again. Readers prune partitions and columns. The input is evaluated once.
    """
    spark, df = df.sparkSession, settle(df, "feature-rows")
    noted = fingerprint(df, columns, f"{tag}:{','.join(df.columns)}").select("fingerprint", F.sha2("fingerprint", 256).alias("name")).first()
    data, side = f"{path}/{noted['name']}/data", f"{path}/{noted['name']}/fingerprint"
    recorded = stored(spark, side)
    if recorded is None or recorded.where(F.col("fingerprint") == noted["fingerprint"]).isEmpty():
        df.write.mode("overwrite").partitionBy(partition).parquet(data)
        spark.createDataFrame([(noted["fingerprint"],)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(side)
    return spark.read.parquet(data)


def write_report(metrics: DataFrame, path: str) -> None:
    """A small metric table as one JSON file; the input must already be aggregated."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
