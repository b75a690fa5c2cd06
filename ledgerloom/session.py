"""Session helpers: a local builder for tests, and lineage cutting for loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: How many times larger than its file a table is taken to be where broadcasts are chosen.
FACTOR, UNPACKED = "spark.sql.sources.fileCompressionFactor", 32.0


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it: lineage ends here.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; without it
    this is an error, as executors could not see a folder of the driver. A table
    knows its size, so what is small is joined by broadcast and nothing else is.
    Packed columns grow many times over as rows of a hash table (1 MB of file to 84 MB
    was seen), which the driver builds; unless the session says otherwise, a file
    counts ``UNPACKED`` times its size in that choice.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if float(spark.conf.get(FACTOR, "1.0")) == 1.0:
        spark.conf.set(FACTOR, str(UNPACKED))
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named)
    folder = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
