"""Files in and out: partitioned CSV, tab-separated points, JSON manifests, GeoJSON folders and trees of slide statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_distances(df: DataFrame, path: str, by: tuple[str, ...] = ("species", "protein")) -> None:
    """CSV with a header, a folder for each value of `by`."""
    df.write.partitionBy(*by).option("header", True).mode("overwrite").csv(path)


def read_distances(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows with a stated schema; a filter on the folders' columns reads those folders alone."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_points(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").mode("overwrite").csv(path)


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated points; files that went missing are skipped."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("ignoreMissingFiles", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_texts(files: DataFrame, path: str, key: str, text: str = "json") -> None:
    """A folder <key>=<value> for each row with its text."""
    files.select(key, F.col(text).alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def read_texts(spark: SparkSession, path: str, text: str = "json") -> DataFrame:
    """Whole files and the columns of their folders."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", text)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made by make() and written first where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_slide_tree(lobules: DataFrame, vessels: DataFrame, path: str) -> None:
    """Two tables in folders subject=.../roi=...: lobules (with `vessel_index`, places in the lobule's slide) and vessels (`i`)."""
    lobules.write.partitionBy("subject", "roi").mode("overwrite").parquet(f"{path}/lobules")
    vessels.write.partitionBy("subject", "roi").mode("overwrite").parquet(f"{path}/vessels")


def read_slide_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lobules and vessels of all subjects and rois; hidden folders are skipped."""
    return spark.read.parquet(f"{path}/lobules"), spark.read.parquet(f"{path}/vessels")


def with_vessels(lobules: DataFrame, vessels: DataFrame, value: Column) -> DataFrame:
    """A row for each lobule and vessel that its indices name (vessel_index is null-safe: no indices, one row without a vessel)."""
    named = lobules.withColumn("i", F.explode_outer("vessel_index")).drop("vessel_index")
    return named.join(vessels.select("subject", "roi", "slide", "i", value.alias("value")), ["subject", "roi", "slide", "i"], "left")


def first_file(files: DataFrame, keys: list[str], name: str, parts: list[str]) -> DataFrame:
    """keys, part, file: the first name of each key that contains the part, null where none does."""
    each = files.select(*keys, name, F.explode(F.array(*map(F.lit, parts))).alias("part"))
    return each.groupBy(*keys, "part").agg(F.min(F.when(F.contains(F.col(name), F.col("part")), F.col(name))).alias("file"))


def paths_by_protein(wanted: DataFrame, there: DataFrame, keys: list[str], protein: str, path: str) -> DataFrame:
    """keys, paths (a map of protein to path), missing (proteins of `wanted` without one, in order); one entry a protein."""
    joined = wanted.select(*keys, protein).distinct().join(there.groupBy(*keys, protein).agg(F.min(path).alias(path)), [*keys, protein], "left")
    return joined.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(path).isNotNull(), F.struct(protein, path))))).alias("paths"),
        F.sort_array(F.collect_list(F.when(F.col(path).isNull(), F.col(protein)))).alias("missing"),
    )


def write_sheets(results: DataFrame, path: str, sheet: str = "sheet") -> None:
    """A report of several sheets: a folder for each, CSV with a header."""
    results.repartition(sheet).write.partitionBy(sheet).option("header", True).mode("overwrite").csv(path)


def read_sheets(spark: SparkSession, path: str, schema: str, chosen: str | None = None, sheet: str = "sheet") -> DataFrame:
    """The sheets of a report as one table, with the sheet's name. chosen: only those whose name the pattern matches; the other folders
    are not read. The schema is that of a sheet, without the name; columns it does not hold are null."""
    found = spark.read.schema(f"{schema}, {sheet} string").option("header", True).csv(path)
    return found if chosen is None else found.where(F.col(sheet).rlike(chosen))


def tagged(sheets: DataFrame, pattern: str, tag: str, renamed: dict[str, str], dropped: tuple[str, ...] = (), sheet: str = "sheet") -> DataFrame:
    """Sheets with a column cut out of their names (null where the pattern does not match), columns renamed and others dropped."""
    out = sheets.withColumn(tag, F.nullif(F.regexp_extract(sheet, pattern, 1), F.lit(""))).drop(sheet, *dropped)
    return out.withColumnsRenamed(renamed)
