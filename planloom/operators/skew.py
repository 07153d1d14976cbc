"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys joined by broadcast. The keys beyond the first HOT_KEYS hold less than
#: 1/HOT_KEYS of the rows each, so no shuffle partition gets more than that from one key.
HOT_KEYS = 128
#: Longest key, in characters over all its columns, that is broadcast: with HOT_KEYS it bounds the broadcast to about a megabyte. Longer
#: hot keys go by shuffle, where adaptive execution splits their partition.
HOT_LENGTH = 4096


def heavy_key_join(rows: DataFrame, entries: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``entries`` (unique by ``keys``), hot keys apart.

    ``entries[weight]`` is the number of rows of the key. The ``HOT_KEYS`` heaviest
    entries no longer than ``HOT_LENGTH``, a fixed number of them, are broadcast; all
    other rows are joined by shuffle. Null keys match nothing. Every row is kept that a plain join keeps.
    """
    length = F.length(F.concat_ws("", *[F.col(k).cast("string") for k in entries.columns if k != weight and not entries.schema[k].dataType.simpleString().startswith(("array", "map", "struct"))]))
    hot = entries.where(length <= HOT_LENGTH).orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    mark = F.broadcast(hot.select(*keys))
    by_broadcast = rows.join(F.broadcast(hot.drop(weight)), keys)
    rest = rows.join(mark, keys, "left_anti")
    cold = entries.join(mark, keys, "left_anti").drop(weight)
    by_shuffle = rest.join(cold, keys)
    return by_broadcast.unionByName(by_shuffle)
