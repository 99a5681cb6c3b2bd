"""Where the operators keep what they write between jobs.

Everything goes below ``spark.checkpoint.dir``, which all executors share. Only a local session (tests on one machine) may
leave it unset; then a temporary folder is used. On a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hashed_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows: those with the smallest hashes of ``key``, whatever the partitioning.

    A threshold from the number of rows first leaves about twice as many, so what is sorted doesn't grow with the corpus.
    """
    n, steps = rows.count(), 1 << 30
    if n > 2 * size:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(steps)) < F.lit(int(steps * 2 * size / n)))
    return rows.orderBy(F.xxhash64(key), key).limit(size)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    import os
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
