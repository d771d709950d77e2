"""Sharpness records: one small YAML file for each image, or a Parquet table.  (S12, K5)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a record, and their types.
FIELDS = {
    "image_filename": "string",
    "max_regional_sharpness": "double",
    "global_sharpness": "double",
    "sharp_region_count": "double",
    "grid_size": "bigint",
    "timestamp": "string",
}


def _field(name: str, kind: str) -> str:
    value = rf"regexp_extract(value, r'(?m)^{name}:[ \t]*(.*?)[ \t]*\r?$', 1)"
    bare = rf"regexp_replace({value}, r'^([\x22\x27])(.*)\1$', '$2')"
    return f"try_cast(nullif({bare}, '') as {kind})"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's .yml and .yaml files as records; files without a name or a score are left out."""
    files = spark.read.option("pathGlobFilter", "*.{yml,yaml}").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = files.select("path", *[F.expr(_field(n, t)).alias(n) for n, t in FIELDS.items()], F.expr(_size(0)).alias("width"), F.expr(_size(1)).alias("height"))
    return rows.filter("image_filename is not null and max_regional_sharpness is not null")


def _size(k: int) -> str:
    """The image size's numbers: a list, in a line each or in brackets."""
    return rf"try_cast(get(regexp_extract_all(regexp_extract(value, r'(?s)image_size:(.*?)(?:\n[a-z_]+:|$)', 1), r'[0-9]+', 0), {k}) as int)"


def as_files(records: DataFrame) -> DataFrame:
    """(name, content): a record's file, for sources.images.write_files()."""
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in FIELDS]
    size = F.format_string("image_size:\n- %d\n- %d\n", "width", "height")
    stem = F.expr("regexp_replace(image_filename, '(?<=.)[.][^.]*$', '')")
    return records.select(F.concat(stem, F.lit(".yml")).alias("name"), F.concat(F.concat_ws("\n", *lines), F.lit("\n"), size).cast("binary").alias("content"))


def replace_table(records: DataFrame, path: str) -> None:
    """The whole table anew, as a run that scores a folder does."""
    records.write.mode("overwrite").parquet(path)
