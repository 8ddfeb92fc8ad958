"""Tables and shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(hadiths: DataFrame, *fields: str, key: str = "rec_id", newest: str = "scraped_at") -> DataFrame:
    """One row per key with the named fields ("ar.matn" becomes matn), in one shuffle with map-side combination.

    Of rows with the same key the newest counts, of equally new ones the one with the greatest fields. Rows
    without a key belong to no record and are left out. Other columns are not read.
    """
    picked = [F.col(f).alias(f.rpartition(".")[2]) for f in fields]
    names = [f.rpartition(".")[2] for f in fields]
    best = F.max(F.struct(F.col(newest).alias("_newest"), *names)).alias("_best")
    return (
        hadiths.where(F.col(key).isNotNull())
        .select(F.col(key), F.col(newest), *picked)
        .groupBy(key)
        .agg(best)
        .select(key, *[F.col(f"_best.{n}").alias(n) for n in names])
    )


def valid_builds(manifest: DataFrame) -> DataFrame:
    """The latest build of every index shard: dfcutoff, dims, vectorcount, doccount, droppedterms."""
    return (
        manifest.groupBy("collection", "first_book", "last_book")
        .agg(F.max(F.struct("built", "build_id", "dfcutoff", "vectors", "doccount", "droppedterms")).alias("b"))
        .select(
            "collection", "first_book", "last_book", "b.dfcutoff", F.col("b.vectors.dims").alias("dims"),
            F.col("b.vectors.vectorcount").alias("vectorcount"), "b.doccount", "b.droppedterms",
        )
    )
