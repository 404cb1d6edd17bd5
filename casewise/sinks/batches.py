"""Tables that grow by parts, where writing a part again replaces it.

A part is all rows with the same values of a few columns, such as one model and iteration, or one micro-batch. It is one folder, and only folders of
the parts that are written are replaced, so a job or a batch that is tried again adds nothing and leaves all others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.scratch import matching


def replace_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows in place of all parts (values of ``by``) that occur in them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_prediction_vectors(vectors: DataFrame, path: str, model: str, iteration: int) -> None:
    """The vector (index, predicted, actual) of one model and iteration."""
    rows = vectors.select(F.lit(model).alias("model"), F.lit(iteration).alias("iteration"), "index", "predicted", "actual")
    replace_parts(rows, path, ["model", "iteration"])


def prediction_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(model, iteration, index, predicted, actual) of all vectors under ``path``."""
    schema = "index bigint, predicted string, actual string, model string, iteration int"
    return spark.read.schema(schema).parquet(path).select("model", "iteration", "index", "predicted", "actual")


def combined_vectors(vectors: DataFrame, models: list[str]) -> DataFrame:
    """(iteration, index, actual, <model>...): one row per position, one column per model, null where a model has no entry there.

    Rows of a position are as many as models, so one aggregation brings them together.
    """
    columns = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models]
    return vectors.groupBy("iteration", "index").agg(F.max("actual").alias("actual"), *columns)


class BatchStats:
    """Running statistics of models, one part per micro-batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Statistics (one row per model) as they stand after a batch."""
        replace_parts(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self.path, ["batch_id"])

    def read(self) -> DataFrame:
        """All statistics with the batch after which they held."""
        if not matching(self.spark, f"{self.path}/batch_id=*"):
            raise ValueError(f"no statistics under {self.path}")
        return self.spark.read.parquet(self.path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
