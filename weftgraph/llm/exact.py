"""Exact dedup by content sort.

Sampled splitters range-partition the rows by their normalised bytes, each partition sorts its texts externally by
their whole content, so that equal texts are neighbours, and neighbours are compared in full. Only the texts that lie
at the two ends of a partition's range may go on in the next one; those, two a partition at most, meet at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, free_names, in_arrow, map_arrow, written

#: Characters of the normalised text in a splitter; where they are the same, the digest of the whole parts the range.
#: Splitters go through the driver, so that they must not hold whole texts.
HEAD = 64


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")


def _sorted(rows: DataFrame, content: Column, id_col: str, sha: str, partitions: int | None) -> DataFrame:
    """The rows with their content's digest, dealt by ranges of content and sorted by the whole content, then the id.

    The id is part of the range key: a text with very many copies is dealt over many partitions.
    """
    (head,) = free_names([*rows.columns, sha], "head")
    keyed = rows.withColumns({head: F.substring(content, 1, HEAD), sha: F.sha2(content, 256)})
    key = [col(head).asc(), col(sha).asc(), col(id_col).asc_nulls_last()]
    dealt = keyed.repartitionByRange(partitions, *key) if partitions else keyed.repartitionByRange(*key)
    return dealt.sortWithinPartitions(content.asc(), col(id_col).asc_nulls_last())


class _Ends:
    """The runs with the least and the greatest range key of a partition: no other run may go on in another one."""

    def __init__(self):
        self.low = self.high = None

    def see(self, texts: pa.Array, shas: pa.Array, runs: np.ndarray, keep: pa.Array, sizes: np.ndarray) -> None:
        """Takes note of whole runs: their text, digest, number, first id and size."""
        heads = pc.utf8_slice_codeunits(texts, 0, HEAD).to_pylist()
        keys = list(zip(heads, shas.to_pylist(), strict=True))
        at = lambda i: (keys[i], int(runs[i]), texts[i].as_py(), keep[i].as_py(), int(sizes[i]))
        least, most = min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)
        if self.low is None or keys[least] < self.low[0]:
            self.low = at(least)
        if self.high is None or keys[most] > self.high[0]:
            self.high = at(most)

    def found(self) -> list[tuple]:
        """(run, text, first id, size), each run once."""
        return list({e[1]: e[1:] for e in (self.low, self.high) if e is not None}.values())


def _starts(texts: pa.Array, before) -> np.ndarray:
    """Where a text differs from the one before it, compared in full."""
    out = np.ones(len(texts), bool)
    if before is not None:
        out[0] = texts[0] != before
    if len(texts) > 1:
        out[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Null texts count as empty. Of equal texts the smallest id stays (a null id only if no other is there); of
    repeated rows with that id exactly one is kept. Empty tables give no rows; other columns are ignored.
    """
    src = docs.select(col(id_col).alias("doc_id"), normalised(col(text_col)).alias("norm"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    ordered = _sorted(src, F.col("norm"), "doc_id", "sha", partitions).select("doc_id", "sha", "norm")
    schema = f"doc_id {id_type}, text_sha256 string, lead boolean, keep {id_type}, size long, pid int, run long, edge string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, run, before, open_ids, open_sha, ends, kind = TaskContext.get().partitionId(), 0, None, [], None, _Ends(), None

        def block(ids, shas, first, sizes, number, edge=None):
            n = len(ids)
            lead = np.zeros(n, bool)
            lead[np.unique(first)] = True
            return pa.RecordBatch.from_arrays(
                [ids, shas, pa.array(lead), ids.take(pa.array(first)), pa.array(sizes), pa.array(np.full(n, pid, np.int32)), pa.array(number), pa.nulls(n, pa.string()) if edge is None else edge],
                ["doc_id", "text_sha256", "lead", "keep", "size", "pid", "run", "edge"],
            )

        def closed():
            """The rows of the run that was open."""
            ids = pa.concat_arrays(open_ids)
            n = len(ids)
            ends.see(pa.array([before.as_py()], pa.string()), pa.array([open_sha]), np.array([run]), ids[:1], np.array([n]))
            return block(ids, pa.array([open_sha] * n, pa.string()), np.zeros(n, np.int64), np.full(n, n, np.int64), np.full(n, run, np.int64))

        for b in batches:
            if not b.num_rows:
                continue
            ids, shas, texts = b.column(0), b.column(1).cast(pa.string()), b.column(2)
            kind, starts = ids.type, _starts(texts, before)
            if open_ids:
                end = starts[0] if len(starts) else len(ids)
                open_ids.append(ids[:end])
                if not len(starts):
                    continue
                yield closed()
                run += 1
            if len(starts) > 1:
                sizes, lo, hi = np.diff(starts).astype(np.int64), starts[0], starts[-1]
                numbers, first = run + np.arange(len(sizes)), pa.array(starts[:-1])
                ends.see(texts.take(first), shas.take(first), numbers, ids.take(first), sizes)
                yield block(ids[lo:hi], shas[lo:hi], np.repeat(starts[:-1] - lo, sizes), np.repeat(sizes, sizes), np.repeat(numbers, sizes))
                run += len(sizes)
            open_ids, open_sha, before = [ids[starts[-1] :]], shas[int(starts[-1])].as_py(), texts[len(texts) - 1]
        if open_ids:
            yield closed()
            runs, texts, keep, sizes = zip(*ends.found(), strict=True)
            yield block(pa.array(keep, kind), pa.nulls(len(runs), pa.string()), np.arange(len(runs)), np.array(sizes, np.int64), np.array(runs, np.int64), pa.array(texts, pa.string()))

    rows = written(in_arrow(ordered, scan, schema), "content-sort")
    ends = rows.where("edge is not null").select("edge", "keep", "size", "pid", "run")
    whole = ends.groupBy("edge").agg(F.min("keep").alias("all_keep"), F.sum("size").alias("all_size"), F.min("pid").alias("first_pid"), F.count(F.lit(1)).alias("parts"))
    # one row for each run that lies in several partitions: no more than two a partition, without its text
    fixed = written(ends.join(whole.where("parts > 1"), "edge").select("pid", "run", "all_keep", "all_size", "first_pid"), "runs-in-parts")
    return (
        rows.where("edge is null").join(fixed, ["pid", "run"], "left")
        .select("doc_id", F.coalesce("all_keep", "keep").alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), (F.col("lead") & F.coalesce(F.col("first_pid") == F.col("pid"), F.lit(True))).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``docs`` with one row of each text: all its columns, the row with the smallest id. Cases as in ``exact_groups``."""
    norm, sha, pid_c, run_c, edge_c = free_names(docs.columns, "norm", "sha", "pid", "run", "edge")
    # the normalised text travels only where it isn't the text itself
    src = docs.withColumn(norm, F.nullif(normalised(col(text_col)), col(text_col)))
    content = F.coalesce(col(norm), col(text_col), F.lit(""))
    ordered = _sorted(src, content, id_col, sha, partitions).select(*map(col, docs.columns), col(sha), content.alias(norm), col(id_col).alias(edge_c))
    width = len(docs.columns)
    schema = docs.select("*", F.lit(0).alias(pid_c), F.lit(0).cast("long").alias(run_c), F.lit("").alias(edge_c)).schema
    for f in schema.fields:
        f.nullable = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, run, ends, like = TaskContext.get().partitionId(), None, 0, _Ends(), None

        def out(columns: list[pa.Array], runs: np.ndarray, edge: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(runs), pid, np.int32)), pa.array(runs.astype(np.int64)), edge], like)

        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b.column(width + 1), before)
            before = b.column(width + 1)[b.num_rows - 1]
            if like is None:
                like = [*b.schema.names[:width], pid_c, run_c, edge_c]
                kinds = [c.type for c in b.columns[:width]]
            if not len(starts):
                continue
            kept, runs = b.take(pa.array(starts)), run + np.arange(len(starts))
            ends.see(kept.column(width + 1), kept.column(width), runs, kept.column(width + 2), np.ones(len(runs)))
            yield out(kept.columns[:width], runs, pa.nulls(len(runs), pa.string()))
            run += len(runs)
        if run:
            found = ends.found()
            yield out([pa.nulls(len(found), k) for k in kinds], np.array([e[0] for e in found]), pa.array([e[1] for e in found], pa.string()))

    rows = written(map_arrow(ordered, scan, schema), "content-sort")
    ends = rows.where(col(edge_c).isNotNull()).select(col(edge_c).alias("edge"), col(pid_c).alias("pid"), col(run_c).alias("run"))
    again = ends.join(ends.groupBy("edge").agg(F.min("pid").alias("first_pid")), "edge").where("pid > first_pid")
    again = written(again.select(F.col("pid").alias(pid_c), F.col("run").alias(run_c)), "runs-in-parts")
    return rows.where(col(edge_c).isNull()).join(again, [pid_c, run_c], "left_anti").select(*map(col, docs.columns))
