"""Values that are computed once per row and then used inside a lambda of transform, filter or zip_with.

The optimiser writes a column's expression wherever the column is used; inside a lambda it would be computed for every
element. let() binds it to a lambda variable instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn: Callable[..., Column], *values: Column | str) -> Column:
    """fn(*values), each value computed once."""
    named = [(F.col(v) if isinstance(v, str) else v).alias(f"v{i}") for i, v in enumerate(values)]
    bound = F.transform(F.array(F.struct(*named)), lambda s: fn(*[s[f"v{i}"] for i in range(len(values))]))
    return F.get(bound, F.lit(0))
