"""Source readers: files, named sheets, queries and captured cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.operators.aggregate import first_value_or_null
from tallymark.operators.align import normalise_columns

QUOTED_NAMES = "spark.sql.ansi.doubleQuotedIdentifiers"


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8",
             schema: T.StructType | str | None = None, multi_line: bool = True,
             broken: str | None = None) -> DataFrame:
    """CSV with a header row. Give a schema to spare the pass that infers one.

    Quoted fields may hold line breaks, doubled quotes and commas. Such a file is read by one task, the
    files of a folder by many; `multi_line=False` lets tasks share large files that are known to have a
    record per line. `broken` names a column with the text of records that have another number of fields
    than the header or values that do not fit the schema; what could be read of them stays in the row, and
    good records have null there. Without it such records stay as they are read.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option(
        "escape", '"').option("multiLine", multi_line)
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if broken:
        schema = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", broken)
    df = reader.schema(schema).option("enforceSchema", True).csv(path)
    return normalise_columns(df, space_to_underscore=True)


def read_sheet(spark: SparkSession, root: str, sheet: str = "Sheet1",
               schema: T.StructType | str | None = None, file_format: str = "parquet") -> DataFrame:
    """A sheet is a folder below `root` that holds one table."""
    path = f"{root}/{sheet or 'Sheet1'}"
    if file_format == "csv":
        return read_csv(spark, path, schema=schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalise_columns(reader.format(file_format).load(path), space_to_underscore=True)


def read_query(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None,
               quoted_names: bool = False) -> DataFrame:
    """Result of a query over the registered views.

    `quoted_names` reads `"Name"` as a column name, as most databases do; the session
    setting is put back at once, since names are bound while the query is analysed.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    if not quoted_names:
        return spark.sql(query)
    previous = spark.conf.get(QUOTED_NAMES)
    spark.conf.set(QUOTED_NAMES, "true")
    try:
        return spark.sql(query)
    finally:
        spark.conf.set(QUOTED_NAMES, previous)


def read_database(spark: SparkSession, query: str, **options: str) -> DataFrame:
    """Result of a query another database runs; options as for Spark's JDBC reader.

    Give `partitionColumn`, bounds and `numPartitions` with `dbtable` in place of the
    query to read a large result in parallel.
    """
    reader = spark.read.format("jdbc").options(**options)
    return (reader if "dbtable" in options else reader.option("query", query)).load()


def read_scalar(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None,
                strict: bool = False) -> DataFrame:
    """One row `(value)`: first row of a one-column query, null when it has none."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return first_value_or_null(spark, query, strict)
