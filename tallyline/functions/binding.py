"""Name a value inside an expression, so that it is computed once.

A filter on a derived column is pushed below the projection that derives it and
takes a copy of the whole expression along. With a value used many times that
copy grows with every use; a bound value is a lambda variable and stays one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda bound: use(bound))[0]
