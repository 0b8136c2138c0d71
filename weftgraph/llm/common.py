"""Helpers that the corpus operators share: written tables, free column names, bounded memory of Python tasks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse
from typing import Any, AnyStr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.tables import dropped, new_folder, shared_dir, written

__all__ = ["SPACES", "Memo", "col", "dropped", "free_names", "hot_join", "in_arrow", "map_arrow", "new_folder", "shared_dir", "stretches", "table", "values", "written"]
#: White space of every contract here, as a Java and Python character class.
SPACES = "[\\x20\\x09-\\x0D]"
#: Bytes that each of a memo's two generations holds, about.
MEMO_BYTES = 12 << 20
#: Bytes of a memo's entry besides its key's letters, about.
ENTRY = 230
#: Keys that a memo looks up at a time.
PART = 1 << 17
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000
#: Rows of a batch whose values are Python objects at the same time.
ROWS = 64
#: Bytes or characters of a text whose words are Python objects at the same time, about.
STRETCH = 1 << 20
#: A key with one in so many rows or more is hot: there are at most that many hot keys, whatever the input.
HOT = 10_000
_SPACE, _SPACE_BYTE = re.compile(SPACES), re.compile(SPACES.encode())

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it clash with no column (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, whatever dots or spaces its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _given_back(scan: Scan) -> Scan:
    """``scan``, which gives free memory back to the system in the end: Spark's Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def in_arrow(df: DataFrame, scan: Scan, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over small batches, whose tasks give their memory back.

    Spark's default of 10,000 rows a batch is for narrow rows: a batch of texts is held several times over, by the
    executor and by its Python worker. The session's setting is lowered to ``BATCH_ROWS``, and stays where it is lower.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(_given_back(scan), schema)


def map_arrow(df: DataFrame, scan: Scan, schema: StructType) -> DataFrame:
    """``in_arrow`` by position: columns may have names with dots in them."""
    names = [f"c{i}" for i in range(len(schema.fields))]
    plain = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields, strict=True)])
    mapped = in_arrow(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), lambda batches: (b.rename_columns(names) for b in scan(batches)), plain)
    return mapped.toDF(*schema.names)


def values(column: pa.Array) -> Iterator[Any]:
    """The values of an Arrow column; only a few are Python objects at a time."""
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def stretches(text: AnyStr | None, size: int | None = None) -> Iterator[AnyStr]:
    """The text cut at white space, so that the words of a very long one are never held all at once; a null has none."""
    if not text:
        return
    size, at, space = size or STRETCH, 0, _SPACE if isinstance(text, str) else _SPACE_BYTE
    while len(text) - at > size:
        cut = space.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class Memo:
    """What a function gives for keys of late, in two generations of bounded size: frequent keys outlive the change.

    ``make`` gets a list of different keys and returns their values in order.
    """

    def __init__(self, make: Callable[[list], Iterable[Any]], most: int | None = None):
        self.make, self.most = make, most or MEMO_BYTES
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def of(self, keys: list) -> Iterator[Any]:
        """The values of the keys, in order."""
        return chain.from_iterable(self._parts(keys))

    def _parts(self, keys: list) -> Iterator[Iterator[Any]]:
        for at in range(0, len(keys), PART):
            if self.held > self.most:  # at the begin: whoever takes the last value doesn't come back
                self.old, self.young, self.held = self.young, {}, 0
            part, young, old = keys[at : at + PART] if len(keys) > PART else keys, self.young, self.old
            new = list(filterfalse(young.__contains__, part))
            if new:
                new = dict.fromkeys(new)
                again = [k for k in new if k in old]
                made = [k for k in new if k not in old]
                young.update(zip(again, map(old.__getitem__, again), strict=True))
                young.update(zip(made, self.make(made), strict=True))
                self.held += 2 * sum(map(len, new)) + ENTRY * len(new)
            yield map(young.__getitem__, part)


def hot_join(rows: DataFrame, by_key: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with a written table of one row a key; ``n`` is a column of that, how many of the rows have the key.

    Hot keys go to the rows by broadcast (they are at most ``HOT``), so that no task gets all rows of one; the rest is
    joined by a shuffle.
    """
    total = by_key.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) * HOT >= F.lit(total)
    few = F.broadcast(by_key.where(hot))
    cold = rows.join(F.broadcast(by_key.where(hot).select(key)), key, "left_anti").join(by_key.where(~hot), key)
    return rows.join(few, key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
