"""Result export: each result table is written as its own parquet (or JSON) dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode(mode).format(fmt).save(path)
        paths[name] = path
    return paths
