"""Readers (S1-S11). All take explicit schemas; nothing is inferred, so ids keep their zeros."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cotejo.session import cut
from cotejo.sources import schemas


def read_json_array(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Objects of JSON array files with ``pos``, their order: file name, then place in the file. Members that are
    absent are null. Files that aren't readable JSON give no rows unless ``strict``. A lost file's rows aren't guessed."""
    reader = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.json(path).withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    # one array file is one task's input, so ids within a file are its order; it is parsed once, then read from storage
    rows = cut(rows).where(F.col("_bad").isNull()).drop("_bad")
    files = rows.groupBy("__file").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__file").collect()  # one row a file
    start, starts = 0, []
    for f in files:
        starts.append((f["__file"], start - f["first"]))
        start += f["n"]
    offsets = spark.createDataFrame(starts, "__file string, __off long")
    return rows.join(F.broadcast(offsets), "__file").withColumn("pos", F.col("__at") + F.col("__off")).drop("__file", "__at", "__off")


def read_products(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_json_array(spark, path, schemas.PRODUCT)


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """One row per map object; a map without ``mapping_results`` has an empty list."""
    rows = spark.read.schema(schemas.CATEGORY_MAP).option("multiLine", True).json(path)
    return rows.withColumn("mapping_results", F.coalesce("mapping_results", F.array().cast(dict(rows.dtypes)["mapping_results"])))


def read_white_labels(spark: SparkSession, path: str) -> list[str]:
    """The pattern list of the configuration file, distinct, in order of code points."""
    rows = spark.read.schema(schemas.WHITE_LABELS).option("multiLine", True).json(path).select(F.explode("general").alias("p")).where(F.col("p").isNotNull()).distinct()
    return sorted(r["p"] for r in rows.collect())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def merge_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of several files, lists extended and single objects appended, by file order in ``paths``; missing files and
    files that aren't JSON are skipped, any other failure is an error."""
    out = None
    for k, path in enumerate(paths):
        if not exists(spark, path):
            continue
        rows = read_json_array(spark, path, schema).withColumn("file_no", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], f"{schema}, pos long, file_no int") if out is None else out


def read_truth(spark: SparkSession, path: str, required: tuple[str, ...] = ("ER Referencia eroski", "Ref competidor"), sep: str = ",") -> DataFrame:
    """Known matches, every column a text. A missing file or a file without the required columns gives no rows."""
    empty = spark.createDataFrame([], schemas.TRUTH)
    if not exists(spark, path):
        return empty
    rows = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("escape", '"').csv(path)
    if not set(required) <= set(rows.columns):
        return empty
    for name in ("Eroski_Denomination", "Makro_Denomination"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.select(*empty.columns)


def read_csv_report(spark: SparkSession, path: str) -> DataFrame:
    """The ``;`` report: all columns texts."""
    return spark.read.option("header", True).option("sep", ";").option("escape", '"').option("multiLine", True).csv(path)


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """The JSON object original to translated as a table; a missing or broken file is an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], "original string, translated string")
    entries = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return entries.select(F.explode("m").alias("original", "translated"))


def read_golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Legacy nested list file as one row ``pair array<array<string>>`` per entry."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<array<string>>>").alias("a"))
    return rows.select(F.explode("a").alias("pair"))


def read_buckets(spark: SparkSession, path: str, category_key: str | None = None, brand_type: str | None = None, schema: StructType | None = None) -> DataFrame:
    """The bucket table; filters on its partition columns prune folders. An empty table needs its ``schema``."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for name, value in (("category_key", category_key), ("brand_type", brand_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def read_category_truth(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The optional evaluation set of category maps, a JSON array of ``source_category, target_category``; none if the
    file isn't there."""
    return read_json_array(spark, path, schemas.CATEGORY_TRUTH).drop("pos") if path and exists(spark, path) else None


def load_json(path: str) -> list:
    """A small local JSON list, such as a list of stop words."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
