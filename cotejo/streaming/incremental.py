"""Catalogue feeds as streams: the same expressions on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cotejo.operators.catalog import classify_brands, product_texts


def product_feed(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """Parquet product files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def texts(feed: DataFrame, white_labels: list[str]) -> DataFrame:
    """Brands and texts of a feed; stateless, so it runs on a stream as on a table."""
    return product_texts(classify_brands(feed, white_labels))


def hourly_counts(feed: DataFrame, time: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """Products per category and hour of scraping; rows later than ``late`` behind the newest are left out."""
    rows = feed.where(F.col(time).isNotNull()).withWatermark(time, late)
    return rows.groupBy(F.window(time, "1 hour").alias("w"), "category").agg(F.count("*").alias("n_products")).select(F.col("w.start").alias("hour"), "category", "n_products")


def upsert_latest(feed: DataFrame, target: str, checkpoint: str, key: str = "id", order: str = "pos", keep: int = 3) -> StreamingQuery:
    """Keeps the last row of each key in a parquet table. Every batch writes a new version folder, named by its batch
    number, so a repeated batch overwrites its own version and readers of the one before aren't disturbed. A version
    that should be there and isn't is an error; of written ones the last ``keep`` stay, at least two."""

    def write(batch: DataFrame, number: int) -> None:
        before = f"{target}/v={number - 1}"
        jvm, conf = batch.sparkSession._jvm, batch.sparkSession._jsparkSession.sessionState().newHadoopConf()
        if number > 0:
            path = jvm.org.apache.hadoop.fs.Path(before)
            if not path.getFileSystem(conf).exists(path):
                raise FileNotFoundError(f"batch {number} needs the version before it, {before}")
            batch = batch.unionByName(batch.sparkSession.read.parquet(before), allowMissingColumns=True)
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
        last.select(key, "r.*").write.mode("overwrite").parquet(f"{target}/v={number}")
        old = jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - max(2, keep)}")
        old.getFileSystem(conf).delete(old, True)

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
