"""tabscope: table profiling and model-diagnosis operators as Spark jobs.

Every public operator takes a DataFrame (plus ``by=[...]`` segment keys,
empty for the whole table) and returns a DataFrame.  Row-level work stays
on the executors; only k x k moment matrices and small result tables are
ever solved outside a Spark aggregation.
"""

from tabscope.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
