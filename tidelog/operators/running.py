"""Running aggregates over a key's rows in order, without one task per key.

The order is cut into blocks. Each (key, block) is reduced to its totals, the totals of earlier
blocks are carried forward over the few block rows of a key, and only inside a block do rows wait
for each other. The result equals a window over the whole key, but a key with a third of all rows
is spread over all its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOTAL = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
_PAIR = {
    "max": F.greatest,
    "min": F.least,
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "last": lambda a, b: F.coalesce(b, a),
}


def running(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], wanted: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """``df`` with a column for each of ``wanted``: name -> (max, min, sum or last, value).

    Blocks are ordered by ``block`` and rows inside by ``order``; ``inclusive`` says whether a row sees itself.
    ``last`` is the last value that is there. A sum starts at 0, the others are null before their first value.
    """
    names = list(wanted)
    rows = df.select("*", *[value.alias(f"_v_{n}") for n, (_, value) in wanted.items()])
    inside = Window.partitionBy(*keys, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.select("*", *[_TOTAL[how](F.col(f"_v_{n}")).over(inside).alias(f"_i_{n}") for n, (how, _) in wanted.items()])
    last = [F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).getField("v") if how == "last" else _TOTAL[how](f"_v_{n}") for n, (how, _) in wanted.items()]
    totals = rows.groupBy(*keys, *block).agg(*[c.alias(f"_t_{n}") for n, c in zip(names, last, strict=True)])
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*keys, *block)], *[_TOTAL[how](F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (how, _) in wanted.items()]
    )
    met = F.lit(True)
    for column in (*keys, *block):
        met = met & F.col(column).eqNullSafe(F.col(f"_k_{column}"))
    results = [_PAIR[how](F.col(f"_b_{n}"), F.col(f"_i_{n}")).alias(n) for n, (how, _) in wanted.items()]
    return rows.join(carried, met).select(*df.columns, *results)
