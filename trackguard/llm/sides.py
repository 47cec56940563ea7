"""The smaller side of a join, and joins on keys some of which have very many rows."""

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.session import is_small

#: Bytes of a stored table, compressed, up to which it is broadcast; in memory it may take several times as much.
LIMIT = 8 << 20


def side(df: DataFrame) -> DataFrame:
    """df, broadcast if its known size is within LIMIT; beyond it the join shuffles. df is a stored table, so its size is known."""
    return F.broadcast(df) if is_small(df, LIMIT) else df


LEAST_HOT, HOT_KEYS = 200, 1000


def hot(weight: str, rows: int) -> Column:
    """Whether a key with so many rows has more than a thousandth of them (and LEAST_HOT); at most HOT_KEYS keys have."""
    return F.col(weight) > max(LEAST_HOT, rows // HOT_KEYS)


def matched(big: DataFrame, one: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """big, a stored table, joined with one, a table of one row per key whose column weight counts the key's rows in big. The few hot
    keys are broadcast, the others are joined by shuffle."""
    is_hot = hot(weight, big.count())
    few = F.broadcast(one.filter(is_hot).drop(weight))
    rest = big.join(few.select(*keys), keys, "left_anti").join(one.filter(~is_hot).drop(weight), keys)
    return big.join(few, keys).unionByName(rest)
