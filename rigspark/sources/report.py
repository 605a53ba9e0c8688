"""Writing report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.rows import friendly_names


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", labels: bool = False) -> dict[str, str]:
    """One folder per table; labels are applied at the sink only."""
    out = {}
    for name, df in tables.items():
        target = f"{path}/{name}"
        (friendly_names(df) if labels else df).write.mode("overwrite").format(fmt).save(target)
        out[name] = target
    return out
