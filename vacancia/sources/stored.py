"""Tables that are derived once and read by many queries: written to the shared folder, kept for the session.

Bridge tables are bucketed and sorted by their key, so that joins and counts by that key need no exchange. Everything goes
below ``spark.checkpoint.dir``; only a local session, as in tests, may leave it unset.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of a map cell.
CELL = 2.0

_KEPT: dict[tuple, str] = {}
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-stored-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` writes to a path, built at the first call for this source in this application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _KEPT:
        path = fresh_path(spark, name)
        build(path)
        _KEPT[key] = path
    return _KEPT[key]


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as they lie in the shared folder: computed once, whoever reads them."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out by ``by`` as ``bucketed`` stores them: what is then counted by it and more needs no further exchange.

    Also for much work on few bytes: a file may be one row group, and then one task, and small partitions are put together.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *by)


def bucketed(spark: SparkSession, name: str, source: str, rows: Callable[[], DataFrame], by: str) -> DataFrame:
    """The rows, which have to be dealt() by ``by``, as a table bucketed and sorted by it: one file for each bucket."""
    key = (spark.sparkContext.applicationId, f"bucketed {name}", source)
    if key not in _KEPT:
        table = f"{name}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        rows().write.bucketBy(buckets, by).sortBy(by).option("path", fresh_path(spark, name)).saveAsTable(table)
        _KEPT[key] = table
    return spark.table(_KEPT[key])


def by_cell(places: DataFrame, path: str) -> None:
    """job_id, lat, lon of the places that are known, so ordered that files and row groups hold places near each other."""
    spots = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("job_id", "lat", "lon")
    files = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cell = [F.floor(F.col("lat") / CELL), F.floor(F.col("lon") / CELL)]
    spots.repartitionByRange(files, *cell, "job_id").sortWithinPartitions(*cell, "lat", "lon").write.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    import zipfile
    from pathlib import Path

    key = (spark.sparkContext.applicationId, "code", "")
    if key in _KEPT:
        return
    root = Path(__file__).resolve().parent.parent
    target = f"{tempfile.mkdtemp(prefix='spark-code-')}/{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _KEPT[key] = target
