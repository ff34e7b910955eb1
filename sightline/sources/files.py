"""Scans: CSV, JSON, label files, image listings. Blank cells are empty strings, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.sources.store import listed


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the schema, taken by the header's names in any order; a value that isn't of its column's type is
    null, and blank strings are ''. A column that the file lacks is an error, but for those in required: they are ''."""
    schema = spark.createDataFrame([], schema).schema
    df = spark.read.option("header", True).csv(path)
    lacks = [f.name for f in schema if f.name not in df.columns and f.name not in required]
    if lacks:
        raise ValueError(f"{path} has no column {', '.join(lacks)}")
    named = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit("").alias(f.name) for f in schema]
    named += [F.lit("").alias(c) for c in required if c not in schema.names and c not in df.columns]
    return df.select(*named).na.fill("", [f.name for f in schema if isinstance(f.dataType, T.StringType)])


def read_csv_trimmed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header names carry blanks: names are trimmed, all columns are strings."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).na.fill("")


def read_keyed(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """One row for each key: the last one of the file."""
    df = read_csv(spark, path, schema).withColumn("_o", F.monotonically_increasing_id())
    cols = [c for c in df.columns if c not in (key, "_o")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), "_o").alias("r")).select(key, "r.*")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table of a path, or no rows where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return read_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


_COCO = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def read_coco(spark: SparkSession, path: str, category: str = "number-plate") -> DataFrame:
    """One row for each image and box of the category (names in lower case, _ as -); images without one
    keep a row with a null box."""
    whole = read_json(spark, path, _COCO)
    images = whole.select(F.inline("images")).withColumnRenamed("id", "image_id")
    boxes = whole.select(F.inline("annotations"))
    wanted = whole.select(F.inline("categories")).filter(F.regexp_replace(F.lower("name"), "_", "-") == category)
    own = boxes.join(wanted.select(F.col("id").alias("category_id")), "category_id", "left_semi").select("image_id", F.col("id").alias("box_id"), "bbox")
    return images.join(own, "image_id", "left")


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Label lines `class xc yc w h` of text files: path, class, box. Strict: a line without five tokens is
    an error. Lenient: such lines, lines with a token that is no number, and classes other than 0, are skipped. Blank lines are no labels."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line <> ''")
    parts = F.split("line", r"\s+")
    if strict:
        lines = lines.withColumn("line", F.when(F.size(parts) == 5, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.col("line"))).cast("string")))
    else:
        lines = lines.filter((F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "0"))
    num = lambda i: F.get(parts, F.lit(i)).cast("double") if strict else F.get(parts, F.lit(i)).try_cast("double")
    if not strict:
        lines = lines.filter(num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull() & num(4).isNotNull())
    return lines.select("path", F.get(parts, F.lit(0)).cast("int").alias("class"), F.struct(num(1).alias("xc"), num(2).alias("yc"), num(3).alias("w"), num(4).alias("h")).alias("box"))


def count_labels(spark: SparkSession, path: str) -> DataFrame:
    """path and n, the number of its lines of five tokens, for every file; a file without any counts 0."""
    # a scan leaves out files of no bytes, so those come from the listing, which tasks make
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  file:/, file:/// and a plain path are one
    every = listed(spark, path).select("path", key("path").alias("_key"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(key(F.col("_metadata.file_path")).alias("_k"), F.size(F.split(F.trim("value"), r"\s+", -1)).alias("tokens"))
    counts = lines.filter("tokens = 5").groupBy("_k").agg(F.count("*").alias("n"))
    return every.join(counts, F.col("_key") == F.col("_k"), "left").select("path", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, sha256 and md5 of the images under a folder. Only what is selected is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def find_by_prefix(keys: DataFrame, files: DataFrame, key: str, pattern: str) -> DataFrame:
    """keys and the first file (by path) whose name has the key by `pattern`, null if none; n tells how many."""
    found = files.withColumn(key, F.regexp_extract("name", pattern, 1)).groupBy(key).agg(F.min("path").alias("path"), F.count("*").alias("n"))
    return keys.join(found, key, "left").na.fill(0, ["n"])


def find_one(keys: DataFrame, files: DataFrame, key: str, pattern: str) -> DataFrame:
    """keys and the file whose name has the key by `pattern`. The job fails at a key that has none or several."""
    found = find_by_prefix(keys, files, key, pattern)
    said = F.concat(F.lit("not one file but "), F.col("n").cast("string"), F.lit(" for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return found.withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(said).cast("string"))).drop("n")
