"""The metadata catalog: versioned documents per dataset, and the master table.

Documents are rows ``version, dataset, subpath, ts, doc_id, metadata, src_schema,
dst_schema_id, mapping``; ``ts`` is a ``yyyyMMddHHmm`` stamp, the three first columns name
the dataset, and at most one document has a given name and stamp.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_parts
from ..plans.paths import MappingError
from ..sources.discovery import list_files
from ..sources.hadoop import exists, input_path
from .mapping import apply_mapping

KEY = ["version", "dataset", "subpath"]
STAMP = "yyyyMMddHHmm"
SECTIONS = ("src_schema", "dst_schema_id", "mapping")
MASTER = ["doc_id", "metadata", "src_schema", "mapping"]
DOCUMENT = (
    "version string, dataset string, subpath string, ts string, doc_id string, "
    "metadata map<string,string>, src_schema string, dst_schema_id string, mapping string"
)

WRITTEN_AT = "written_at"

# fixed values: the metadata fields every dataset is offered
DEFAULT_FIELDS = [
    "_size", "_records", "_link", "_dataset_description", "_source_type", "_created_at", "_license",
    "_content_size", "_dataset_name", "_subpath", "_id_hash", "_lang", "_file_name", "_tags",
]


# -- versions ---------------------------------------------------------------------------


def latest(docs: DataFrame, key: Sequence[str] = tuple(KEY), stamp: str = "ts") -> DataFrame:
    """The newest document of each dataset.

    Aggregated before the shuffle: whatever number of versions a dataset has, each task
    sends one of them.
    """
    rest = [c for c in docs.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.col(stamp)).alias("doc")
    return docs.groupBy(*key).agg(newest).select(*key, "doc.*").select(*docs.columns)


def obsolete(docs: DataFrame, key: Sequence[str] = tuple(KEY), stamp: str = "ts") -> DataFrame:
    """Every document but the newest of each dataset: what goes to the archive."""
    newest = docs.groupBy(*key).agg(F.max(stamp).alias(stamp))
    # joined on name and stamp, so that a dataset with very many versions spreads over tasks; null parts of a key are equal
    newest = newest.select(*[F.col(c).alias(f"__{c}") for c in [*key, stamp]])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*key, stamp]])
    return docs.join(newest, same, "left_anti").select(*docs.columns)


def append_version(docs: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Add documents as the newest version, stamped ``now`` to the minute.

    A document written twice within one minute replaces itself.
    """
    stamp = F.date_format(F.current_timestamp() if now is None else now, STAMP)
    stamped = new.withColumn("ts", stamp).select(*docs.columns)
    return docs.join(stamped.select(*KEY, "ts"), [*KEY, "ts"], "left_anti").unionByName(stamped)


def restore(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Current documents after taking back the archived versions in ``chosen``.

    ``chosen`` holds ``version, dataset, subpath, ts`` of what to restore, one per dataset.
    The current name and stamp stay, the content is that of the archived version.
    """
    content = [c for c in docs.columns if c not in (*KEY, "ts")]
    wanted = chosen.groupBy(*KEY).agg(F.max("ts").alias("ts"))
    archived = docs.join(wanted, [*KEY, "ts"], "left_semi").select(*KEY, F.struct(*content).alias("_old"))
    current = latest(docs).join(archived, KEY, "left")
    return current.select(
        *KEY, "ts", *[F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col(c)).alias(c) for c in content]
    ).select(*docs.columns)


# -- master table -----------------------------------------------------------------------


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str = "doc_id",
    *,
    null_aware: bool = False,
    newest_by: str | None = None,
) -> DataFrame:
    """Old rows whose key is not among the new ones, and all new rows.

    With ``newest_by`` a batch may hold several versions of a key: the largest by that
    column is kept. ``null_aware`` follows SQL ``NOT IN``: a null among the new keys drops
    every old row, and an old null key stays only if nothing is new.
    """
    if newest_by is not None:
        new = latest(new, [key], newest_by)
    new = new.select(*old.columns)
    if not null_aware:
        return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)
    # NOT IN spelled out: as a predicate it would have to broadcast all new keys
    facts = new.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    is_empty = facts.select(F.col("n") == 0).scalar()
    no_null = facts.select(F.col("nulls") == 0).scalar()
    kept = old.where(is_empty | (no_null & F.col(key).isNotNull()))
    return kept.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def master_rows(docs: DataFrame, *more: str) -> DataFrame:
    """The four columns of the master table, metadata as JSON text; and ``more`` columns as they are."""
    return docs.select(
        "doc_id", F.to_json("metadata").alias("metadata"), "src_schema", "mapping", *more
    )


# -- document content -------------------------------------------------------------------


def metadata_set(metadata: Column, name: str, value: Column) -> Column:
    """Set one metadata value, replacing an earlier one."""
    return F.map_concat(metadata_remove(metadata, name), F.create_map(F.lit(name), value))


def metadata_remove(metadata: Column, name: str) -> Column:
    return F.map_filter(metadata, lambda k, _: k != F.lit(name))


def set_section(docs: DataFrame, section: str, value: str | Column, where: Column) -> DataFrame:
    """Documents with ``section`` replaced where ``where`` holds."""
    if section not in SECTIONS:
        raise ValueError(f"section must be one of {', '.join(SECTIONS)}")
    new = F.lit(value) if isinstance(value, str) else value
    return docs.withColumn(section, F.when(where, new).otherwise(F.col(section)))


def fill_keys(docs: DataFrame) -> DataFrame:
    """Absent parts of documents as empty ones."""
    empty = {
        "doc_id": F.lit(""),
        "metadata": F.create_map().cast("map<string,string>"),
        "src_schema": F.lit("{}"),
        "dst_schema_id": F.lit(""),
        "mapping": F.lit("[]"),
    }
    return docs.select(*[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in docs.columns])


def init_missing(datasets: DataFrame, docs: DataFrame, base: str, now: Column | None = None) -> DataFrame:
    """New empty documents for datasets that have none; the document id is the dataset path."""
    stamp = F.date_format(F.current_timestamp() if now is None else now, STAMP)
    missing = datasets.select(*KEY).distinct().join(docs.select(*KEY).distinct(), KEY, "left_anti")
    blank = missing.select(
        *KEY,
        stamp.alias("ts"),
        F.concat_ws("/", F.lit(base.rstrip("/")), *KEY).alias("doc_id"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        *[F.lit(None).cast("string").alias(section) for section in SECTIONS],
    )
    return fill_keys(blank)


# -- metadata fields --------------------------------------------------------------------


def field_name(name: Column) -> Column:
    """Metadata fields always start with an underscore."""
    trimmed = F.trim(name)
    return F.when(trimmed.startswith("_"), trimmed).otherwise(F.concat(F.lit("_"), trimmed))


def add_fields(registry: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry (column ``field``) with new fields added, and the names rejected as known."""
    wanted = names.select(field_name(F.col("field")).alias("field")).where(F.length("field") > 1).distinct()
    added = registry.select("field").unionByName(wanted.join(registry, "field", "left_anti"))
    return added, wanted.join(registry, "field", "left_semi")


def remove_fields(registry: DataFrame, names: DataFrame) -> DataFrame:
    return registry.join(names, "field", "left_anti")


def all_fields(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Fields configured or used anywhere, sorted."""
    used = docs.select(F.explode(F.map_keys("metadata")).alias("field"))
    return registry.select("field").unionByName(used).distinct().orderBy("field")


def default_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in DEFAULT_FIELDS], "field string")


# -- documents as files -----------------------------------------------------------------


def read_documents(spark: SparkSession, folder: str, *, skip_broken: bool = False) -> DataFrame:
    """Catalog documents from JSON files below ``folder``.

    The name ``version__dataset__subpath__stamp`` is that of the file or of a folder above. A document that is not
    valid JSON fails the read, rather than to stand as an empty newest version; ``skip_broken`` leaves it out.
    Files without such a name are no documents: :func:`other_files` lists them.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    named = files.select(_document_name(input_path()).alias("name"), "value").where(F.col("name") != "")
    if skip_broken:
        named = named.where(F.try_parse_json("value").isNotNull())
    content = "doc_id string, metadata map<string,string>, src_schema string, dst_schema_id string, mapping string"
    parsed = named.select(*key_parts(F.col("name")), F.from_json("value", content, {"mode": "FAILFAST"}).alias("doc"))
    return parsed.select(*KEY, "ts", "doc.*")


def _document_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/=]+__[^/]+__[^/]+__[0-9]{12})(?:\.json)?(?:/|$)", 1)


def other_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the JSON files below ``folder`` that no document's name leads to, so that none goes missing unseen."""
    found = list_files(spark, folder).where(F.col("path").endswith(".json"))
    return found.where(_document_name(F.col("path")) == "").select("path")


def list_target_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Target schemas of a folder as ``name, schema`` (JSON text)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("schema"))


def load_target_schema(spark: SparkSession, folder: str, name: str) -> dict:
    row = list_target_schemas(spark, folder).where(F.col("name") == name).first()
    if row is None:
        raise FileNotFoundError(f"no target schema {name!r} in {folder}")
    return json.loads(row["schema"])


def map_from_catalog(
    df: DataFrame,
    docs: DataFrame,
    dataset: dict[str, str],
    target_schema: dict | None,
    **options,
) -> DataFrame:
    """Map ``df`` by the mapping in the latest document of ``dataset`` (a KEY -> value dict)."""
    chosen = docs
    for column in KEY:
        chosen = chosen.where(F.col(column) == dataset[column])
    row = chosen.agg(F.max_by("mapping", "ts").alias("mapping")).first()
    mapping = json.loads(row["mapping"] or "[]")
    if not mapping:
        raise MappingError(f"no mapping for {'/'.join(dataset[c] for c in KEY)}")
    return apply_mapping(df, mapping, target_schema, **options)


class Catalog:
    """The catalog of one folder: an append-only table of documents, from which the master table is derived."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.documents_path = f"{folder.rstrip('/')}/documents"

    def _written(self) -> DataFrame:
        """All documents that were ever written, with the time of writing."""
        schema = f"{DOCUMENT}, {WRITTEN_AT} timestamp"
        if not exists(self.spark, self.documents_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.documents_path)

    def documents(self) -> DataFrame:
        # a document written again within its minute replaces the earlier one
        return latest(self._written(), [*KEY, "ts"], WRITTEN_AT).drop(WRITTEN_AT)

    def current(self) -> DataFrame:
        return latest(self.documents())

    def archive(self) -> DataFrame:
        return obsolete(self.documents())

    def add(self, new: DataFrame, now: datetime | None = None) -> None:
        """Append new versions: one plain write, after which both tables hold them."""
        if now is None:
            now = datetime.now()
        names = [field.split(" ")[0] for field in DOCUMENT.split(", ")]
        stamped = new.withColumn("ts", F.lit(now.strftime("%Y%m%d%H%M"))).select(*names)
        # of several documents of one dataset in a batch one stays, the same in both tables
        stamped = latest(stamped.withColumn("order", F.to_json(F.struct(*names))), KEY, "order").select(*names)
        stamped.withColumn(WRITTEN_AT, F.current_timestamp()).write.mode("append").parquet(self.documents_path)

    def set_section(self, section: str, value: str, dataset: dict[str, str], now: datetime | None = None) -> None:
        rows = self.current()
        for column in KEY:
            rows = rows.where(F.col(column) == dataset[column])
        self.add(set_section(rows, section, value, F.lit(True)), now)

    def master(self) -> DataFrame:
        """The master table: of each document id the row that was written last, derived from the documents as they are read.

        Documents are reduced within the tasks, so what moves is one row for each id and task.
        """
        rows = master_rows(self._written(), WRITTEN_AT).withColumn("order", F.struct(WRITTEN_AT, *MASTER))
        return latest(rows, ["doc_id"], "order").select(*MASTER)

    def export_master(self, path: str) -> None:
        """The master table as it is now, as parquet in a new folder: for readers that would else derive it again and again."""
        self.master().write.parquet(path)


__all__ = [
    "Catalog", "add_fields", "all_fields", "append_version", "default_registry", "fill_keys", "init_missing",
    "latest", "list_target_schemas", "load_target_schema", "map_from_catalog", "master_rows", "metadata_remove",
    "metadata_set", "obsolete", "other_files", "read_documents", "remove_fields", "restore", "set_section",
    "upsert",
]
