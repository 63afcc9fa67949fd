"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run of these characters separates words in most contracts.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A join key is hot from this share of all rows on, so there are at most so many hot keys.
HOT_KEYS = 1000
#: Rows that a key needs at least to count as hot.
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one JVM (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Let the session's Arrow batches hold fewer rows and bytes than by default: a batch of whole texts is in memory twice,
    in the JVM and in Python. Smaller settings of the caller stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(-?\d+)([kmgt]?)", str(spark.conf.get(key)).lower())
    held = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[now[2]]
    if not 0 < held <= megabytes << 20:
        spark.conf.set(key, megabytes << 20)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """left.join(right, keys), right having each key once, without a task that gets all rows of a hot key.

    counts has the keys and n, how many rows of left have them, out of total. A key with over 1 / HOT_KEYS of the rows is
    hot: its rows stay where they are and meet right's rows for the hot keys, at most HOT_KEYS, by broadcast. All
    other rows are shuffled.
    """
    # Such tables grow with the input: they are shuffled at any size, so that small runs show what large ones do.
    right_ = right.hint("merge")
    if total <= HOT_ROWS:
        return left.join(right_, keys)
    hot = materialize(counts.filter(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right_, keys)
    hot = F.broadcast(hot)
    spread = left.join(F.broadcast(right.join(hot, keys, "left_semi")), keys)
    return spread.unionByName(left.join(hot, keys, "left_anti").join(right_, keys))


def words(text: Column) -> Column:
    """Words of a text that is not null; an empty array where it has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def others(columns: list[str], *added: str) -> list[str]:
    """Columns without those of an added name, in any case."""
    new = {c.lower() for c in added}
    return [c for c in columns if c.lower() not in new]


def pack(df: DataFrame, *own: str) -> DataFrame:
    """df with only the columns own and one struct of all columns, so that no added name clashes with the input's."""
    return df.select(*own, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unpack(packed: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The packed columns and the added ones; an added column replaces a packed one of its name (in any case)."""
    return packed.select(*[F.col("__row").getField(c).alias(c) for c in others(columns, *added)], *[x.alias(c) for c, x in added.items()])
