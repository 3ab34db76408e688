"""Keys of whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes of a whole text, together a 128-bit key."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
