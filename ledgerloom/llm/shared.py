"""Intermediate tables and model files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of a text, and what separates words. Fixed values of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, with its file system.

    Only where the session names no such folder (tests, a laptop) is one made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if "://" not in base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(base or tempfile.mkdtemp(prefix="shared-"))
        base = re.sub(r"^(\w+):/(?=[^/])", r"\1:///", context.getCheckpointDir())
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table and read again: lineage ends here.

    A lost executor costs the tasks it ran, never what is already written.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hash60(*parts) -> Column:
    """A number below 2^60 from the md5 of the parts' texts, as SQL elsewhere makes it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column)
                              else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
