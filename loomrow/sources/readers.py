"""Reading datasets: parquet, JSON Lines (plain or gzipped), CSV and TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import quote_name
from .discovery import DATA_EXTENSIONS, SAMPLE_EXTENSIONS, discover_files
from .hadoop import input_path, is_file, qualified
from .json_lines import BAD_LINE, checked_objects, found_schema, typed_objects

#: name of the input file a row came from
FILE_NAME = "_file_name"


def _named(df: DataFrame, file_name: bool) -> DataFrame:
    return df.withColumn(FILE_NAME, input_path()) if file_name else df


def _reader(spark: SparkSession, path: str, pattern: str | None):
    reader = spark.read
    if "*" not in path and not is_file(spark, path):
        reader = reader.option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
    return reader


def read_parquet(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    merge_schema: bool = False,
    file_name: bool = False,
) -> DataFrame:
    """Parquet file, folder (walked recursively) or glob.

    ``merge_schema`` reads every footer to find columns only some files have; a given
    ``schema`` needs no footer at all.
    """
    reader = _reader(spark, path, "*.parquet").option("mergeSchema", str(merge_schema).lower())
    return _named((reader.schema(schema) if schema else reader).parquet(path), file_name)


def read_json_lines(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    fail_fast: bool = False,
    file_name: bool = False,
    pattern: str = "*.{json,jsonl,jsonl.gz,json.gz}",
) -> DataFrame:
    """One JSON object per line; gzipped files are recognised by their name.

    Lines that are not one JSON object are kept with their text in ``_bad_line``; with ``fail_fast`` the job stops at the
    first one. Blank lines are skipped. A value that is not of its field's type is null, its line a good one (see
    :func:`json_lines.typed_objects`). Giving ``schema`` saves the extra pass over the data that finding the columns takes.
    """
    reader = _reader(spark, path, pattern)
    if fail_fast:
        reader = reader.option("mode", "FAILFAST")
        return _named((reader.schema(schema) if schema else reader).json(path), file_name)
    return parse_json_lines(_named(reader.text(path), file_name), schema)


def parse_json_lines(
    lines: DataFrame, schema: T.StructType | str | None = None, *, bad_fields: bool = False
) -> DataFrame:
    """Rows of ``schema`` and ``_bad_line`` out of the text column ``value``; other columns stay."""
    objects = checked_objects(lines)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return typed_objects(objects, found_schema(objects) if schema is None else schema, bad_fields=bad_fields)


def typed_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines as ``schema``, ``_bad_line``, ``_bad_fields`` (names of fields that do not fit) and ``_file_name``."""
    lines = _named(_reader(spark, path, "*.{json,jsonl,jsonl.gz}").text(path), True)
    return parse_json_lines(lines, schema, bad_fields=True)


def read_json_variant(
    spark: SparkSession, path: str, *, column: str = "value", file_name: bool = False
) -> DataFrame:
    """JSON Lines as one VARIANT column, keeping missing keys apart from nulls.

    Needs no schema, so no pass to find one. Lines that are not one JSON object have a null ``value`` and their text in
    ``_bad_line``; blank lines are skipped.
    """
    lines = _named(_reader(spark, path, "*.{json,jsonl,jsonl.gz,json.gz}").text(path), file_name)
    return checked_objects(lines, column)


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    separator: str = ",",
    multi_line: bool = False,
    file_name: bool = False,
) -> DataFrame:
    """CSV with a header line. Types are found, by an extra pass, unless ``schema`` is given.

    Large files are split. Quoted fields that span lines need ``multi_line``, which makes each file one task.
    """
    reader = (
        _reader(spark, path, None)
        .option("header", "true")
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
    )
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return _named(df, file_name)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tab-separated values with a header line."""
    return read_csv(spark, path, separator="\t", **options)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the bad lines, of a JSON scan."""
    bad = F.col(BAD_LINE).isNotNull()
    rest = [c for c in df.columns if c in (FILE_NAME, BAD_LINE)]
    return df.where(~bad).drop(BAD_LINE), df.where(bad).select(*rest)


def file_kinds(spark: SparkSession, path: str) -> dict[str, int]:
    """Number of data files at or below ``path`` by kind, ``parquet`` or ``json``."""
    kind = F.when(F.col("path").endswith(".parquet"), "parquet").otherwise("json").alias("kind")
    counted = discover_files(spark, path, DATA_EXTENSIONS).groupBy(kind).count()
    return {row["kind"]: row["count"] for row in counted.collect()}


def read_dataset(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    kinds: dict[str, int] | None = None,
    file_name: bool = False,
) -> DataFrame:
    """All supported files at or below ``path``, whatever their formats, as one DataFrame.

    A folder may mix parquet and JSON Lines: the parts are joined by column name. Without
    ``schema`` all footers and JSON lines are looked at first to find every column. ``kinds``
    is the result of :func:`file_kinds`, to spare a second listing.
    """
    kinds = file_kinds(spark, path) if kinds is None else kinds
    if not kinds:
        raise FileNotFoundError(f"no supported data file at {path}")
    parts = []
    if "parquet" in kinds:
        parts.append(read_parquet(spark, path, schema=schema, merge_schema=schema is None, file_name=file_name))
    if "json" in kinds:
        parts.append(
            read_json_lines(spark, path, schema=schema, file_name=file_name, pattern="*.{json,jsonl,jsonl.gz}")
        )
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def sample_rows(
    spark: SparkSession, folder: str, k: int = 1, *, order_by: tuple[str, ...] = (), max_len: int = 120
) -> DataFrame | None:
    """First ``k`` rows of the first supported file in ``folder``, texts shortened.

    None where the folder holds no supported file. Only as much of the file is read as the rows take, and types are found in
    these rows alone. With ``order_by`` the rows are the smallest by those columns of the whole file instead.
    """
    files = discover_files(spark, folder, SAMPLE_EXTENSIONS, below=False)
    plain = F.regexp_replace(F.col("path"), "^([a-z0-9+.-]+:)/+", "$1/")
    direct = files.where(F.regexp_replace(plain, "/[^/]*$", "") == qualified(spark, folder))
    first = direct.agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        return None
    whole = bool(order_by)
    if first.endswith(".parquet"):
        df = read_parquet(spark, first)
        df = df if whole else _first(df, k)
    elif first.endswith((".csv", ".tsv")):
        separator = "\t" if first.endswith(".tsv") else ","
        if whole:
            df = read_csv(spark, first, separator=separator, multi_line=True)
        else:
            df = _with_types(_first(_csv_texts(spark, first, separator), k))
    else:
        objects = checked_objects(_reader(spark, first, None).text(first)).where(F.col(BAD_LINE).isNull())
        if not whole:
            # lines rather than values go through the driver: they are read again as what they are
            lines = objects.select(F.to_json("value").alias("value")).take(k)
            objects = checked_objects(spark.createDataFrame(lines, "value string"))
        df = typed_objects(objects, found_schema(objects)).drop(BAD_LINE)
    return sample(df, k, order_by=order_by, max_len=max_len)


def _first(df: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows, read split by split until there are enough; they are few, and pass through the driver."""
    return df.sparkSession.createDataFrame(df.take(k), df.schema)


def _csv_texts(spark: SparkSession, path: str, separator: str) -> DataFrame:
    reader = spark.read.option("header", "true").option("sep", separator).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", "true").csv(path)


def _with_types(df: DataFrame) -> DataFrame:
    """Text columns as the first type that all their values have."""
    kinds = ("bigint", "double", "boolean", "timestamp")

    def fits(name: str, kind: str):
        col = F.col(quote_name(name))
        return F.bool_and(col.isNull() | col.try_cast(kind).isNotNull()) & (F.count(col) > 0)

    found = df.agg(*[fits(name, kind).alias(f"c{i}_{kind}") for i, name in enumerate(df.columns) for kind in kinds]).first()
    columns = []
    for i, name in enumerate(df.columns):
        kind = next((kind for kind in kinds if found[f"c{i}_{kind}"]), "string")
        columns.append(F.col(quote_name(name)).cast(kind).alias(name))
    return df.select(*columns)


def sample(df: DataFrame, k: int = 1, *, order_by: tuple[str, ...] = (), max_len: int = 120) -> DataFrame:
    """``k`` normalised rows, the smallest by ``order_by`` if given (kept per task, then merged)."""
    from ..operators.normalize import normalize

    return normalize(df.orderBy(*order_by).limit(k) if order_by else df.limit(k), max_len=max_len)
