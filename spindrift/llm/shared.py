"""Building blocks that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a membership filter: 16 for each member, within these bounds. A filter is broadcast as
#: 64-bit words, so it never has more than MOST_BITS / 64 rows. False hits cost time only.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: A key with over 1/HOT_SHARE of all rows is hot. There can be no more than HOT_SHARE of them,
#: which bounds what is broadcast.
HOT_SHARE = 256


def own_name(what: str) -> str:
    """A column name that no table has."""
    return f"_{what}_{uuid.uuid4().hex[:12]}"


class MemberFilter:
    """A bit filter over a column of values; it never misses a member."""

    def __init__(self, members: DataFrame, value: str):
        n = members.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
        self.bit, self.place, self.word = own_name("bit"), own_name("place"), own_name("word")
        self.words = (
            members.select(self._at(F.col(f"`{value}`")).alias("b"))
            .groupBy((F.col("b") / 64).cast("int").alias(self.place))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias(self.word))
        )

    def _at(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.bits))

    def mark(self, rows: DataFrame, value: str | Column, name: str = "hit") -> DataFrame:
        """Adds a boolean: whether the filter may have the value, which must be of the members' type.
        Nothing moves."""
        probe = F.col(f"`{value}`") if isinstance(value, str) else value
        probed = rows.withColumn(self.bit, self._at(probe)).withColumn(self.place, (F.col(self.bit) / 64).cast("int"))
        probed = probed.join(F.broadcast(self.words), self.place, "left")
        hit = F.expr(f"coalesce(shiftright({self.word}, CAST({self.bit} % 64 AS INT)) & 1L = 1L, false)")
        return probed.withColumn(name, hit).drop(self.bit, self.place, self.word)

    def keep(self, rows: DataFrame, value: str) -> DataFrame:
        hit = own_name("hit")
        return self.mark(rows, value, hit).where(hit).drop(hit)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per ``key``; ``size``: its rows) without skew.

    Hot keys, of which there are HOT_SHARE at most, are labelled where they are; all others meet
    their group by key. ``key`` must not be null in ``groups``.
    """
    hot = F.col(size) * HOT_SHARE > total
    names = {c: own_name("hot") for c in groups.columns if c != key}
    far = groups.where(hot).withColumnsRenamed(names)
    marked = rows.join(F.broadcast(far), key, "left")
    there = marked.where(F.col(names[size]).isNotNull()).withColumnsRenamed({new: c for c, new in names.items()})
    rest = marked.where(F.col(names[size]).isNull()).drop(*names.values())
    return rest.join(groups.where(~hot), key, "left").unionByName(there)
