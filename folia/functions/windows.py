"""Window functions that take one pass over a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def following_known(value: Column | str, group: str, order: str, own: bool = False) -> Column:
    """The first value that isn't null in the rows behind (with ``own``, in the row itself before them).

    A frame up to a group's end is computed anew for every row, so the rows are taken from the end backwards.
    """
    back = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return F.last(value, ignorenulls=True).over(back)
