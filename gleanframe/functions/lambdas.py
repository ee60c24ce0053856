"""Small helpers for higher-order column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A column expression written twice inside a lambda is evaluated twice, and an
    outer expression referenced inside a lambda is evaluated once per element.
    Binding it as a lambda variable keeps both to exactly one evaluation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
