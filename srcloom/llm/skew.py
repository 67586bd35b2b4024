"""Joins whose keys may be held by a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key is hot.
HOT_SHARE = 1 / 4000


def joined(left: DataFrame, right: DataFrame, keys: list[str], weight: str, n_left: int, share: float = HOT_SHARE) -> DataFrame:
    """`left` inner joined with `right`, which has each of `keys` once and in `weight` how many rows of `left` hold it.

    Keys with at least `share` of the n_left rows, of which there are at most 1 / share, are joined by broadcast; their
    rows never enter the shuffle of the others. Give written tables, as both are read twice.
    """
    hot = F.broadcast(right.filter(F.col(weight) >= int(n_left * share) + 1).drop(weight))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.drop(weight), keys)
    return cold.unionByName(left.join(hot, keys))
