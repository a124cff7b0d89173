"""Written tables, joins that deal out hot keys and small SQL helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread_join(rows: DataFrame, named: DataFrame, key: str, by: list[str], salts: int = 64) -> DataFrame:
    """rows.join(named, key) where named has one row a key but very many rows may share one.

    A key's rows are dealt out by a hash of ``by``; named is copied only to the (key, salt) that occur.
    """
    salt = "_chronomill_salt"
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)))
    known = salted.select(key, salt).distinct().join(named, key)
    return salted.join(known, [key, salt]).drop(salt)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
