"""Mapping datasets into a target schema: projection, validation, preview and whole jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_to_schema
from ..plans.json_schema import is_object, struct_of
from ..plans.mapper import CompiledMapping, compile_mapping, error, nullable_type
from ..plans.paths import MappingError, quote_name
from ..plans.typed import Typed, convert, null_of, unify
from ..plans.validator import Nulls, compile_validation

ERRORS = "_errors"
VALID = "_valid"


def apply_mapping(
    df: DataFrame,
    mapping: list[dict],
    target_schema: dict | None = None,
    *,
    keep: Sequence[str] = (),
    errors: bool = False,
    **options,
) -> DataFrame:
    """Rows of ``df`` turned into target rows by ``mapping``.

    ``keep`` lists source columns to carry along in front; ``errors`` adds the list of
    values that could not be coerced. ``options`` go to :func:`compile_mapping`. The plan is
    one projection: no shuffle, and only the source fields the mapping names are read.
    """
    compiled = compile_mapping(df.schema, mapping, target_schema, **options)
    kept = [F.col(quote_name(name)) for name in keep]
    extra = [compiled.cast_errors.alias(ERRORS)] if errors else []
    return df.select(*kept, *compiled.columns, *extra)


def map_and_validate(
    df: DataFrame,
    mapping: list[dict],
    target_schema: dict,
    *,
    keep: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Map, then check every row: adds ``_errors`` (coercion and schema errors) and ``_valid``."""
    compiled = compile_mapping(df.schema, mapping, target_schema, **options)
    flags = {name: f"_written_{n}" for n, name in enumerate(compiled.written)}
    mapped = df.select(
        *[F.col(quote_name(name)) for name in keep],
        *compiled.columns,
        compiled.cast_errors.alias("_cast_errors"),
        *[compiled.written[name].alias(flag) for name, flag in flags.items()],
    )
    nulls = Nulls.of_mapping(compiled.present, {name: F.col(flag) for name, flag in flags.items()})
    found = compile_validation(compiled.schema, target_schema, nulls)
    checked = mapped.withColumn(ERRORS, F.concat("_cast_errors", found)).drop("_cast_errors", *flags.values())
    return checked.withColumn(VALID, F.size(ERRORS) == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid target rows, and rejected rows with their errors, of a checked dataset.

    Meant for stored data: two uses of a plan map every row twice. To store both parts in
    one pass use :func:`loomrow.sinks.files.write_checked`.
    """
    return checked.where(F.col(VALID)).drop(ERRORS, VALID), checked.where(~F.col(VALID))


def preview_mapping(
    df: DataFrame,
    mapping: list[dict],
    target_schema: dict | None,
    n: int = 5,
    *,
    order_by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """``n`` source rows next to what they become, as structs ``source`` and ``target``."""
    compiled = compile_mapping(df.schema, mapping, target_schema, **options)
    first = df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
    return first.select(F.struct("*").alias("source"), F.struct(*compiled.columns).alias("target"))


def conform(df: DataFrame, target_schema: dict) -> DataFrame:
    """Select exactly the fields of ``target_schema``, coerced to its types at every level.

    Absent fields are completed as for a mapping of every column to itself; what the schema
    does not know is dropped.
    """
    wanted = struct_of(target_schema)
    itself = [
        {"src_field": name, "target_field": name, "transformation": "src"}
        for name in wanted.names
        if name in df.columns
    ]
    compiled = compile_mapping(df.schema, itself, target_schema)
    row = Typed(None, compiled.schema, solid=True)
    properties = target_schema["properties"]
    columns = [_fit(row.field(f.name), properties[f.name], f.dataType).col.alias(f.name) for f in wanted]
    return df.select(*compiled.columns).select(*columns)


def _fit(value: Typed, schema: dict, dtype: T.DataType) -> Typed:
    """Coerce ``value`` into the type of its schema, level by level."""
    if isinstance(dtype, T.ArrayType) and isinstance(value.dtype, T.ArrayType):
        items, element = schema.get("items") or {}, value.dtype.elementType
        col = F.transform(value.col, lambda x: _fit(Typed(x, element), items, dtype.elementType).col)
        return Typed(col, dtype)
    if isinstance(dtype, T.StructType) and isinstance(value.dtype, T.StructType) and is_object(schema):
        fields = [
            (_fit(value.field(f.name), schema["properties"][f.name], f.dataType)
             if f.name in value.dtype.names else null_of(f.dataType)).col.alias(f.name)
            for f in dtype
        ]
        return Typed(F.when(value.col.isNotNull(), F.struct(*fields)), dtype)
    if isinstance(dtype, (T.ArrayType, T.StructType)) and not isinstance(value.dtype, T.VariantType):
        return null_of(dtype)
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return Typed(value.col.try_cast(dtype), dtype)
    return convert(cast_to_schema(value, schema)[0], dtype)


#: what became of a row or line
OUTCOME = "_outcome"
#: text of a line that could not be read
LINE = "_line"
RUN = "_run_id"
MAPPED, FLAWED, REFUSED = "mapped", "flawed", "refused"


@dataclass(frozen=True)
class MappingRun:
    """Counts of one mapping job, and the rows per input file as a DataFrame.

    ``flawed_rows`` are mapped rows in which a value could not be read or coerced; they count as processed, too.
    ``problems`` is the folder that holds refused lines and the errors of flawed rows, None if there are none.
    """

    total_files: int
    successful_files: int
    total_processed_samples: int
    rejected_lines: int
    per_file: DataFrame
    flawed_rows: int = 0
    run_id: str = ""
    problems: str | None = None


def with_outcomes(
    source: DataFrame, mapping: list[dict], target_schema: dict | None = None, *, run_id: str = "", **options
) -> DataFrame:
    """Every row and refused line of ``source`` with its outcome: nothing is left out.

    Columns are ``_run_id``, ``_file_name``, ``_outcome`` (``mapped``; ``flawed``: mapped, but a value could not be read or coerced;
    ``refused``: a line that is no JSON object), ``_line`` (its text), ``_errors``, and the target fields, null in refused
    lines. One projection, no shuffle; it runs on streams, too.
    """
    from ..sources.json_lines import BAD_FIELDS, BAD_LINE
    from ..sources.readers import FILE_NAME

    has = {name: name in source.columns for name in (BAD_LINE, BAD_FIELDS, FILE_NAME)}
    compiled = compile_mapping(source.schema, mapping, target_schema, **options)
    none = F.lit(None).cast("string")
    line = F.col(BAD_LINE) if has[BAD_LINE] else none
    unread = F.transform(
        F.col(BAD_FIELDS), lambda name: error(name, "type", "could not be read as the type its field has")
    ) if has[BAD_FIELDS] else None
    errors = compiled.cast_errors if unread is None else F.concat(unread, compiled.cast_errors)
    # a refused line has no fields to coerce
    flat = source.select(
        F.lit(run_id).alias(RUN),
        (F.col(FILE_NAME) if has[FILE_NAME] else none).alias(FILE_NAME),
        line.alias(LINE),
        F.when(line.isNull(), errors).alias(ERRORS),
        *[F.when(line.isNull(), column).alias(name) if has[BAD_LINE] else column
          for column, name in zip(compiled.columns, compiled.schema.names)],
    )
    outcome = F.when(F.col(LINE).isNotNull(), REFUSED).when(F.size(ERRORS) > 0, FLAWED).otherwise(MAPPED)
    return flat.withColumn(OUTCOME, outcome).select(RUN, FILE_NAME, OUTCOME, LINE, ERRORS, *map(quote_name, compiled.schema.names))


def map_dataset(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    mapping: list[dict],
    target_schema: dict | None = None,
    *,
    source_schema: T.StructType | None = None,
    single_pass: bool = False,
    mode: str = "errorifexists",
    by_outcome: bool = False,
    problems_path: str | None = None,
    **options,
) -> MappingRun:
    """Map every supported file below ``input_path`` and write parquet to ``output_path``.

    Rows keep the name of their input file in ``_file_name`` and the job's in ``_run_id``; counts are observed while the job
    runs, so a job that appends reports its own rows. JSON Lines are mapped as semi-structured values: no pass looks for
    their columns, and no key or value can stop the job. Target fields that the schema gives no type, or without a schema all,
    get the type of their values by one more pass; with ``single_pass`` they stay VARIANT. With
    ``source_schema`` fields are read as its types first.

    Nothing is dropped. Refused lines, and the errors of rows in which values could not be coerced, are written to
    ``problems_path`` (``<output_path>_problems``) by a second pass, if there are any. With ``by_outcome`` there is one pass:
    it writes the folders ``_outcome=mapped``, ``_outcome=flawed`` and ``_outcome=refused`` below ``output_path``.
    """
    from ..sinks.files import write_mapped
    from ..sources.json_lines import settled
    from ..sources.readers import FILE_NAME, file_kinds, read_json_variant, read_parquet, typed_json_lines

    if not mapping:
        raise MappingError("the mapping is empty")
    kinds = file_kinds(spark, input_path)
    if not kinds:
        raise FileNotFoundError(f"no supported data file at {input_path}")
    run_id = uuid.uuid4().hex
    parts = []
    if "parquet" in kinds:
        rows = read_parquet(spark, input_path, schema=source_schema, merge_schema=source_schema is None, file_name=True)
        parts.append(with_outcomes(rows, mapping, target_schema, run_id=run_id, **options))
    if "json" in kinds and source_schema is not None:
        lines = typed_json_lines(spark, input_path, source_schema)
        parts.append(with_outcomes(lines, mapping, target_schema, run_id=run_id, **options))
    elif "json" in kinds:
        lines = read_json_variant(spark, input_path, file_name=True)
        parts.append(with_outcomes(lines, mapping, target_schema, run_id=run_id, root="value", **options))
    found = reduce(together, parts)
    fields = [name for name in found.columns if name not in (RUN, FILE_NAME, OUTCOME, LINE, ERRORS)]
    if not single_pass and "json" in kinds and source_schema is None:
        found = settled(found, fields)
    counts = Observation("outcomes")
    seen = found.observe(counts, *[F.count_if(F.col(OUTCOME) == kind).alias(kind) for kind in (MAPPED, FLAWED, REFUSED)])
    if by_outcome:
        seen.write.mode(mode).partitionBy(OUTCOME).parquet(output_path)
    else:
        kept = [quote_name(name) for name in (FILE_NAME, *fields, RUN)]
        write_mapped(seen.where(F.col(OUTCOME) != REFUSED).select(*kept), output_path, mode=mode)
    counted = counts.get
    problems = None
    if by_outcome:
        problems = output_path
    elif counted[FLAWED] + counted[REFUSED]:
        problems = problems_path or output_path.rstrip("/") + "_problems"
        odd = found.where(F.col(OUTCOME) != MAPPED).select(RUN, FILE_NAME, OUTCOME, LINE, ERRORS)
        odd.write.mode("append" if mode == "append" else mode).parquet(problems)
    stored = spark.read.parquet(output_path).where(F.col(RUN) == run_id)
    per_file = map_dataset_stats(stored.where(F.col(OUTCOME) != REFUSED) if by_outcome else stored)
    return MappingRun(
        sum(kinds.values()), per_file.count(), counted[MAPPED] + counted[FLAWED], counted[REFUSED], per_file,
        counted[FLAWED], run_id, problems,
    )


def together(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; a column that both have in different types gets one that holds both."""
    columns = {name: left.schema[name].dataType for name in left.columns}
    for field in right.schema:
        columns[field.name] = unify(columns.get(field.name, T.NullType()), nullable_type(field.dataType))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[
            (convert(Typed(F.col(quote_name(name)), nullable_type(df.schema[name].dataType)), dtype).col
             if name in df.columns else null_of(dtype).col).alias(name)
            for name, dtype in columns.items()
        ])

    return shaped(left).unionByName(shaped(right))


def map_dataset_stats(mapped: DataFrame) -> DataFrame:
    """Rows per input file of mapped data."""
    from ..sources.readers import FILE_NAME

    return mapped.groupBy(FILE_NAME).agg(F.count("*").alias("rows"))


__all__ = [
    "CompiledMapping",
    "MappingRun",
    "apply_mapping",
    "conform",
    "map_and_validate",
    "map_dataset",
    "map_dataset_stats",
    "preview_mapping",
    "split_valid",
    "with_outcomes",
]
