"""Evaluate an expression once and use it many times inside array lambdas.

Spark evaluates an outer expression again for every element of a lambda that mentions it. Binding it
to a lambda variable evaluates it once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
