"""Whether the ids of several tables agree: which ids one side lacks, and a gate that lets no bad row through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import written


def misaligned(column: str = "node", **sides: DataFrame) -> DataFrame:
    """<column>, side, rows: each id that a side lacks and another has, with how many rows the others have of it.

    The sides are tables by name; an id that two of three lack is in two rows. A null id is an id that no side should
    have: it is lacking everywhere (side ``any``). All sides meet in one aggregation, whose partial sums keep ids that
    very many rows have from meeting in one task.
    """
    if len(sides) < 2:
        raise ValueError("at least two tables are compared")
    each = [t.select(F.col(column), *(F.lit(int(name == other)).alias(f"in_{other}") for other in sides)) for name, t in sides.items()]
    seen = reduce(DataFrame.unionByName, each).groupBy(column).agg(*(F.sum(f"in_{name}").alias(f"in_{name}") for name in sides))
    total = reduce(lambda x, y: x + y, (F.col(f"in_{name}") for name in sides))
    lacks = F.filter(F.array(*(F.when(F.col(column).isNotNull() & (F.col(f"in_{name}") == 0), F.lit(name)) for name in sides)), lambda s: s.isNotNull())
    return seen.select(column, F.explode(F.when(F.col(column).isNull(), F.array(F.lit("any"))).otherwise(lacks)).alias("side"), total.alias("rows"))


def gated(table: DataFrame, name: str, **bad: Column) -> DataFrame:
    """``table``, written; ValueError if a row is true for one of the conditions ``bad``, with their counts.

    Counts are observed as the rows are written, so that the gate costs no pass of its own.
    """
    seen = Observation(name)
    out = written(table.observe(seen, *(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, c in bad.items())), name)
    wrong = {k: n for k, n in seen.get.items() if n}
    if wrong:
        raise ValueError(f"{name}: " + ", ".join(f"{n} rows are {k}" for k, n in sorted(wrong.items())))
    return out


def aligned(table: DataFrame, known: DataFrame, name: str, *columns: str, show: int = 5) -> DataFrame:
    """``table``, written, if all ids in ``columns`` are among the column node of ``known`` and none is null; else ValueError with some of the ids."""
    flagged = table
    for c in columns:
        has = known.select(F.col("node").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
        flagged = flagged.join(has, c, "left")
    try:
        out = gated(flagged, name, **{f"unknown_{c}": F.col(f"has_{c}").isNull() for c in columns})
    except ValueError as e:
        sides = [misaligned(c, known=known.select(F.col("node").alias(c)), table=table.select(c)).where("side IN ('known', 'any')").select(F.col(c).cast("string").alias("id")) for c in columns]
        some = [r.id for r in reduce(DataFrame.unionByName, sides).distinct().orderBy("id").limit(show).collect()]
        raise ValueError(f"{e}, such as {', '.join('null' if i is None else i for i in some)}") from None
    return out.select(*table.columns)
