"""Tables written to the shared folder, and a seed-free row identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` beside the checkpoints and go on from the written rows, so that a lost executor costs no recomputation."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_hash(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def power_of_two(least: int, wanted: float) -> int:
    """Smallest power of two that is at least both numbers."""
    return 1 << max(least - 1, int(wanted) - 1, 1).bit_length()
