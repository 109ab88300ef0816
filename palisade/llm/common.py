"""What the operators of this subpackage share: input, scratch tables, word rules."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression class; a word is a maximal run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\u000b\u000c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a temporary folder serves, and only in local mode: on a
    cluster executors would not see it, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that Spark hands to Python, where ``small_batches`` was called.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands texts to Python in batches of ``BATCH_BYTES`` at most, or of the session's own bound if that is less.

    By default a batch is a whole file split of texts, which an executor then holds several times a task. The
    setting stays, as results are lazy; no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (no nulls in, none out)."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def bucket(rows: int, per_bucket: int) -> int:
    """How many buckets hold ``rows`` at about ``per_bucket`` each."""
    return max(1, -(-rows // per_bucket))


#: Words and pre-tokens longer than this (bytes or characters) are never sent to all workers.
LONGEST = 64


def merged(parts: DataFrame, fan_in: int = 16):
    """Sum of pickled tuples of arrays, one row each, by a tree of ``fan_in``; None for no rows.

    At most ``fan_in`` sums of one fixed size reach the driver, all in one job.
    """

    def add(rows):
        total = None
        for x in rows:
            got = pickle.loads(bytes(x))
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        return [] if total is None else [pickle.dumps(total)]

    rdd = parts.rdd.map(lambda r: r[0])
    while rdd.getNumPartitions() > fan_in:
        rdd = rdd.mapPartitions(add).repartition(-(-rdd.getNumPartitions() // fan_in))
    got = add(rdd.mapPartitions(add).collect())
    return pickle.loads(got[0]) if got else None
