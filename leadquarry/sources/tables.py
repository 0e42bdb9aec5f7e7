"""Reading business and purchase tables, writing results, saving model bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadquarry.operators.rank import row_numbers
from leadquarry.session import cut

BUSINESS_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "name", "address", "phone", "website", "email", "category", "search_category", "governorate")],
    *[T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "rating", "reviews")],
])


def _format(path: str) -> str:
    return "csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               multi_line: bool = True) -> DataFrame:
    """Parquet keeps its types; CSV is read with a header and quoted line breaks.

    Without a schema every CSV column is a string: nothing is inferred by an extra pass.
    Quoted line breaks keep a file in one task; pass ``multi_line=False`` for large files
    without them so that they split."""
    if _format(path) == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        return reader.csv(path)
    # read by header name, then cast: files may order or omit columns
    raw = reader.csv(path)
    return raw.select(*[
        F.col(c).try_cast(schema[c].dataType).alias(c) if c in schema.names else F.col(c) for c in raw.columns])


def require_column(df: DataFrame, column: str, path: str = "input") -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found in {path}; it has {df.columns}")
    return df


def read_businesses(spark: SparkSession, path: str, name: str = "name", id_col: str = "biz_id",
                    multi_line: bool = True) -> DataFrame:
    """Businesses with an id in file order; ``multi_line=False`` lets large CSV files split."""
    return require_column(with_row_id(read_table(spark, path, BUSINESS_SCHEMA, multi_line), id_col), name, path)


def with_row_id(df: DataFrame, id_col: str) -> DataFrame:
    """An explicit id 0, 1, ... by file name and place inside the file, where the table has none.

    ``df`` must come straight from files.  Rows of one split are read in order, so the split's
    start and the row's place in its task order them, whatever splits a task is given."""
    if id_col in df.columns:
        return df
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"),
                       F.monotonically_increasing_id().alias("__row"))
    numbered = row_numbers(cut(placed), [F.asc("__file"), F.asc("__from"), F.asc("__row")], "__n")
    return numbered.withColumn(id_col, F.col("__n") - 1).drop("__file", "__from", "__row", "__n")


def read_below_titles(spark: SparkSession, path: str, name: str, max_titles: int = 3) -> DataFrame:
    """One delimited file whose header may sit under up to three title lines.

    Its first lines are matched against the wanted column; the file is then read as strings
    with the right number of lines skipped.
    """
    lines = spark.read.text(path).limit(max_titles + 1).collect()          # four lines
    for skip, row in enumerate(lines):
        header = spark.createDataFrame([(row.value,)], "value string")
        names = [c.strip() for c in _split_line(header)]
        if name in names:
            blank = sum(not r.value.strip() for r in lines[:skip])         # the CSV reader drops blank lines
            return _read_skipping(spark, path, names, skip - blank)
    raise ValueError(f"column '{name}' not found in the first {max_titles + 1} lines of {path}; "
                     f"first lines: {[r.value for r in lines]}")


def _split_line(one_row: DataFrame) -> list[str]:
    """Fields of one CSV line, split by Spark's own parser."""
    text = one_row.first().value
    width = text.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = one_row.select(F.from_csv("value", schema).alias("r")).first().r
    return [v for v in parsed if v is not None]


def _read_skipping(spark: SparkSession, path: str, names: Sequence[str], skip: int) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.option("multiLine", True).option("escape", '"').schema(schema)
    if skip == 0:
        return reader.option("header", True).csv(path)
    # multi-line CSV is one task per file, so ids inside a file follow the lines
    rows = reader.option("header", False).csv(path).withColumn("__line", F.monotonically_increasing_id())
    rows = rows.withColumn("__line", F.col("__line").bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.where(F.col("__line") > skip).drop("__line")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists (newest labelled table first)."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def write_table(df: DataFrame, path: str, sort: Sequence = (), single_file: bool = False) -> None:
    """Parquet or CSV by suffix.  ``single_file`` is for small reports only."""
    if sort:
        df = df.orderBy(*sort)
    if single_file:
        df = df.coalesce(1)
    writer = df.write.mode("overwrite")
    if _format(path) == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.parquet(path)


def write_json(spark: SparkSession, summary: dict, path: str) -> None:
    """One nested row as JSON text."""
    spark.createDataFrame([(json.dumps(summary),)], "value string").write.mode("overwrite").text(path)


def save_bundle(model: PipelineModel, meta: dict, path: str,
                calibrator: IsotonicRegressionModel | PipelineModel | None = None) -> None:
    """All that scoring new rows takes: fitted pipeline, calibrator, feature list, types, threshold."""
    model.write().overwrite().save(f"{path}/model")
    if calibrator is not None:
        calibrator.write().overwrite().save(f"{path}/calibrator")
    spark = SparkSession.getActiveSession()
    kind = None if calibrator is None else "sigmoid" if isinstance(calibrator, PipelineModel) else "isotonic"
    meta = meta | {"calibrated": calibrator is not None, "calibration": kind}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, IsotonicRegressionModel | PipelineModel | None, dict]:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    kind = PipelineModel if meta.get("calibration") == "sigmoid" else IsotonicRegressionModel
    calibrator = kind.load(f"{path}/calibrator") if meta["calibrated"] else None
    return PipelineModel.load(f"{path}/model"), calibrator, meta
