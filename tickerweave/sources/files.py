"""Tolerant CSV and JSON sources, and file sinks. Paths are folders that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as missing in a CSV cell.
MISSING = ["", "NA", "N/A", "n/a", "nan", "NaN", "NULL", "null", "None", "#N/A", "<NA>"]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tickerweave.files", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tickerweave-")
        spark.conf.set("spark.tickerweave.files", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _reader(spark: SparkSession, header: bool = True, encoding: str = "UTF-8", multi_line: bool = True):
    return (
        spark.read.option("header", header).option("mode", "DROPMALFORMED").option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("encoding", encoding).option("enforceSchema", True).option("ignoreCorruptFiles", True)
    )


def _typed(df: DataFrame, schema: T.StructType, columns: list[str]) -> DataFrame:
    """String cells as their types; MISSING cells are null, and a row with a cell that is neither missing nor of its type is dropped."""
    as_type = {c: missing_to_null(F.col(f"`{c}`")) if isinstance(schema[c].dataType, T.StringType) else F.expr(f"try_cast(`{c}` as {schema[c].dataType.simpleString()})") for c in columns}
    for c in columns:
        if not isinstance(schema[c].dataType, T.StringType):
            as_type[c] = F.when(~F.col(f"`{c}`").isin(MISSING), as_type[c])
            df = df.filter(as_type[c].isNotNull() | F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(MISSING))
    return df.withColumns({c: x for c, x in as_type.items()})


def read_csv(
    spark: SparkSession, path, schema: str | T.StructType, columns: list[str] | None = None, glob: str | None = None, encoding: str = "UTF-8",
    exclude: list[str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """Malformed lines are skipped; all MISSING tokens are null, in columns of any type; ``columns`` are pruned at the scan.

    ``exclude``: names of files that are left out. Without ``multi_line`` no
    cell may hold a line end, and large files are read in parts.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = _reader(spark, True, encoding, multi_line)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)
    if exclude:
        df = df.filter(~F.col("_metadata.file_name").isin(exclude))
    columns = columns or schema.names
    return _typed(df.select(*[F.col(f"`{c}`") for c in columns]), schema, columns)


def missing_to_null(x: Column) -> Column:
    return F.when(~x.isin(MISSING), x)


def read_folder_by_name(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All CSV files of a folder; ``ticker`` is the file's name, in capitals. Corrupt files are skipped (``skipped_files`` lists them)."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.csv$", 1)
    df = _reader(spark).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).option("pathGlobFilter", "*.csv").csv(path)
    return _typed(df.withColumn("ticker", F.upper(name)), schema, schema.names)


def skipped_files(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """(ticker) of the CSV files in a folder that gave ``read_folder_by_name`` no row.

    The folder is listed by the file system, as Spark's own listing leaves files of no bytes out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    files = [f.getPath().getName() for f in listed if f.isFile()]
    names = spark.createDataFrame([(f[:-4].upper(),) for f in files if f.endswith(".csv") and f[0] not in "._"], "ticker string")
    return names.join(read.select("ticker").distinct(), "ticker", "left_anti")


def normalised_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Names stripped and in lower case, then renamed; an 'adj close' takes the place of 'close', null or not."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "adj close" in df.columns and "close" in df.columns:
        df = df.drop("close").withColumnRenamed("adj close", "close")
    return df.withColumnsRenamed(renames or {})


def news_files(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = ("date", "title", "news", "url")) -> DataFrame:
    """Files (or folders of them) whose headers may be missing, as one frame with (file, row) of where each line came from.

    ``file`` is the number of the path. A file whose first line names one of
    the fields (as a whole cell) has a header; all its lines that equal it are
    dropped. In another one every line is data. The first columns are taken
    by position; files with fewer, and empty ones, are left out. All files are
    read by one scan, and one more for their first lines.
    """
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{f} string" for f in fields) + ", file int, row long")
    at = F.col("_metadata.file_path")
    lines = spark.read.text(paths).select(at.alias("path"), "value", F.monotonically_increasing_id().alias("i"), F.col("_metadata.file_block_start").alias("b"))
    first = lines.filter("b = 0 and trim(value) <> ''").groupBy("path").agg(F.min_by("value", "i").alias("head"))
    cells = F.transform(F.split("head", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    first = first.filter(F.size(F.split("head", ",")) >= len(fields)).withColumn("named", F.arrays_overlap(cells, F.array(*map(F.lit, fields)))).withColumn("cells", F.slice(cells, 1, len(fields)))
    # one row for each file from here on: which of the given paths it is in
    given = spark.createDataFrame([(i, p.rstrip("/").split(":", 1)[-1].lstrip("/")) for i, p in enumerate(paths)], "file int, given string")
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:", ""), "^/+", "")
    of = first.join(F.broadcast(given), (plain == F.col("given")) | plain.startswith(F.concat("given", F.lit("/")))).groupBy("path").agg(F.first("named").alias("named"), F.first("cells").alias("cells"), F.min("file").alias("file"))
    raw = _reader(spark, header=False).option("mode", "PERMISSIVE").schema(", ".join(f"`{f}` string" for f in fields)).csv(paths)
    rows = raw.select(*fields, at.alias("path"), F.monotonically_increasing_id().alias("row")).join(of, "path")
    own = F.array(*[F.lower(F.trim(F.coalesce(F.col(f), F.lit("")))) for f in fields])
    return rows.filter(~F.col("named") | (own != F.col("cells"))).select(*[missing_to_null(F.col(f)).alias(f) for f in fields], "file", "row")


def rest_news(landed: DataFrame, json_col: str = "body") -> DataFrame:
    """(symbol, Date, News) out of landed JSON replies: arrays of items with datetime (epoch seconds) and headline. Bad or empty replies give no rows."""
    items = F.from_json(json_col, "array<struct<datetime:long,headline:string>>")
    return landed.select("symbol", F.explode(items).alias("x")).select("symbol", F.timestamp_seconds("x.datetime").alias("Date"), F.col("x.headline").alias("News"))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that a crawler has landed: url, html. Fetching itself is left to the crawler."""
    return spark.read.parquet(path).select("url", "html")


def landed_prices(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Landed daily prices from ``start`` up to, not including, ``end``."""
    return spark.read.parquet(path).filter((F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date")))


def trials(spark: SparkSession, path: str, one_each: bool = True) -> DataFrame:
    """Trial logs: one JSON object a file, or (without ``one_each``) one a line."""
    return spark.read.option("multiLine", one_each).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "error").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stage(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The Parquet table at ``path``; it is made unless a finished one is there (or ``force``)."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume_chunks(df: DataFrame, chunk: Column, path: str) -> DataFrame:
    """Writes the chunks that ``path`` doesn't have yet, each as its own partition, and returns all of them."""
    spark = df.sparkSession
    rows = df.withColumn("chunk", chunk)
    if exists(spark, path):
        have = spark.read.parquet(path).select("chunk").distinct()
        rows = rows.join(have, "chunk", "left_anti")
    rows.write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) of every output."""
    made = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        made = row if made is None else made.unionByName(row)
    return made


def with_sizes(spark: SparkSession, made: DataFrame, paths: dict[str, str]) -> DataFrame:
    """``summary``'s rows with ``kb``, what each table's files take on disk."""
    def size(path):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() / 1024.0

    return made.join(spark.createDataFrame([(n, size(p)) for n, p in paths.items()], "`table` string, kb double"), "table", "left")


def save_run(predictions: DataFrame, log: DataFrame, model, path: str) -> None:
    """A model run's outputs side by side: predictions and training log as tables, the model as itself."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    log.write.mode("overwrite").parquet(f"{path}/log")
    model.write().overwrite().save(f"{path}/model")
