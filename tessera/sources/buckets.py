"""Tables in buckets of a key: a batch rewrites the buckets of its keys and leaves the files of all others as they are.

A table is a folder partitioned by a hash of its keys. What a batch changes is worked out from the touched buckets alone, which
are then overwritten by partition. A batch that is repeated after a failure changes nothing more: upserts, replacements and
deletions give the same rows again. A bucket that has lost all its rows is kept by one row that marks it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from tessera.sources.scratch import materialize
from tessera.sources.tables import cascade_delete, replace_documents, upsert

BUCKETS = 64


@dataclass
class BucketedTable:
    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("_live", BooleanType()).add("_bucket", IntegerType())
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:  # nothing has been written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().filter("_live").select(*self.schema.names)

    def merge(self, keys: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> None:
        """The buckets of keys with fold(their rows) in place of their rows. There are at most as many buckets as were chosen."""
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        if not touched:
            return
        old = self._stored().filter(F.col("_live") & F.col("_bucket").isin(touched)).select(*self.schema.names)
        rows = fold(old).select(*self.schema.names).withColumn("_live", F.lit(True)).withColumn("_bucket", self._bucket())
        marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("_live"), "_bucket")
        staged = materialize(rows.unionByName(marks), "staged")
        # A bucket goes to a few files, more if it is large.
        dealt = staged.hint("rebalance", F.col("_bucket"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def upsert(self, rows: DataFrame, recency: str, created: str | None = None) -> None:
        """The newest row of each key stays, as upsert has it."""
        rows = materialize(rows.select(*self.schema.names), "batch")
        self.merge(rows, lambda old: upsert(old, rows, self.keys, recency, created))

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows of the keys in rows, and of the keys gone, go; rows are added. keys are those of a document."""
        rows = materialize(rows.select(*self.schema.names), "batch")
        replaced = rows.select(*self.keys) if gone is None else rows.select(*self.keys).unionByName(gone.select(*self.keys))
        self.merge(replaced, lambda old: replace_documents(old, rows, self.keys[0]) if gone is None else (
            old.join(replaced.distinct(), self.keys, "left_anti").select(*old.columns).unionByName(rows)))

    def delete(self, ids: DataFrame) -> None:
        """Without the rows whose first key is an id of ids."""
        named = ids.select(F.col("id").alias(self.keys[0])).distinct()
        self.merge(named, lambda old: cascade_delete({"t": (old, self.keys[0])}, ids)["t"])
