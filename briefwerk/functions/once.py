"""Name an intermediate value inside an expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    A filter on a derived column is pushed down by writing the whole derivation into the
    filter. Long chains whose steps are used twice each would double at every step; with
    the steps named like this the expression stays as short as it is written.
    """
    return F.get(F.transform(F.array(value), use), 0)
