"""Column expressions (JVM-side, codegen-friendly) used by the operators."""

from confluo.functions.nulls import as_double, col_ref, is_numeric_type, null_or_nan
from confluo.functions.text import normalize_text
from confluo.functions.shapes import shape_to_regex, value_shape
from confluo.functions.fuzzy import name_key, name_ratio

__all__ = [
    "as_double", "col_ref", "is_numeric_type", "null_or_nan",
    "normalize_text", "value_shape", "shape_to_regex",
    "name_key", "name_ratio",
]
