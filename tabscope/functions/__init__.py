from tabscope.functions.columns import (
    is_stat_numeric, is_overview_numeric, stat_numeric_columns, overview_kind,
    nan_to_null, finite_or_null, lexical_kind, dtype_name, seg_cols,
)

__all__ = [
    "is_stat_numeric", "is_overview_numeric", "stat_numeric_columns", "overview_kind",
    "nan_to_null", "finite_or_null", "lexical_kind", "dtype_name", "seg_cols",
]
