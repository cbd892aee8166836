"""Normalise chat and instruction datasets into one target schema, on Spark."""

from .functions.registry import TransformRegistry, register_transform
from .operators.inference import infer_schema, infer_schema_json
from .operators.mapping import apply_mapping, conform, map_and_validate, map_dataset, preview_mapping
from .operators.normalize import normalize
from .operators.query import run_sql
from .operators.validation import dataset_eligible, validate_rows, validation_report
from .plans.mapper import compile_mapping
from .plans.paths import MappingError
from .session import get_session

__all__ = [
    "MappingError", "TransformRegistry", "apply_mapping", "compile_mapping", "conform", "dataset_eligible",
    "get_session", "infer_schema", "infer_schema_json", "map_and_validate", "map_dataset", "normalize",
    "preview_mapping", "register_transform", "run_sql", "validate_rows", "validation_report",
]
