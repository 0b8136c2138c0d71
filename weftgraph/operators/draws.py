"""Sums over random draws, whose digests are worked out side by side in numpy (see ``functions.digests``).

What a draw is stays what ``draw_index`` and ``draw_key`` say; here, no row is made for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.columns import draw_key
from ..functions.digests import WIDE, Tails, heads
from ..plans.rank import first_in
from ..plans.tables import written

#: Members of a set that are summed at a time.
BLOCK = 4096
#: Standard deviations that the number of small enough keys stays within; repetitions with others are drawn once more, in full.
SLACK = 6.0
#: Graphs whose sums a task holds at the same time.
HELD = 64


def node_values(quartiles: DataFrame, inter: DataFrame, by: tuple[str, ...], taus: list[float]) -> DataFrame:
    """by, node, degree, bin and x0, x1, ..: inter_deg at each tau, null where there is none. One row a node."""
    each = [F.max(F.when(F.col("tau") == F.lit(t), F.col("inter_deg"))).alias(f"x{i}") for i, t in enumerate(taus)]
    return quartiles.join(inter.groupBy(*by, "node").agg(*each), [*by, "node"], "left")


def taus_of(inter: DataFrame) -> list[float]:
    """The different taus, a few; one without rows where there are none."""
    return sorted(r.tau for r in inter.select("tau").distinct().collect()) or [0.0]


def _sum_columns(taus: list[float]) -> list[tuple[str, str]]:
    return [(f"{c}{i}", t) for i in range(len(taus)) for c, t in (("n", "long"), ("d", "long"), ("s", "long"), ("r", "double"))]


def _values(rows: pa.Table, n_taus: int) -> np.ndarray:
    """Of each row and tau: 1, degree, inter_deg and their ratio; zeros where inter_deg is missing."""
    degree = rows.column("degree").to_numpy().astype(np.float64)
    out = np.zeros((len(degree), 4 * n_taus))
    for i in range(n_taus):
        x = rows.column(f"x{i}").to_numpy().astype(np.float64)
        there = ~np.isnan(x)
        x = np.where(there, x, 0.0)
        out[:, 4 * i : 4 * i + 4] = np.stack([there, degree * there, x, x / np.maximum(1.0, degree)], 1)
    return out


def _sums(values: np.ndarray) -> list[pa.Array]:
    """The columns of ``_sum_columns``: whole numbers are below 2^53, so that doubles hold them."""
    return [pa.array(values[:, i] if i % 4 == 3 else np.rint(values[:, i]).astype(np.int64)) for i in range(values.shape[1])]


def by_tau(sums: DataFrame, keys: list[str], taus: list[float]) -> DataFrame:
    """keys, tau, n, d, s, r in place of the columns of all taus; taus without any row are left out."""
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), *[F.col(f"{c}{i}").alias(c) for c in "ndsr"]) for i, t in enumerate(taus)])
    return sums.select(*keys, F.explode(rows).alias("t_")).select(*keys, "t_.*").where("n > 0")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _prefixes(seed: int, what: str, strategy: str, reps: list[int]) -> list[bytes]:
    return [f"{seed}:{what}:{strategy}:{r}:".encode() for r in reps]


def _even(reps: list[int], wide: int) -> Iterator[list[int]]:
    """The repetitions in groups of at most ``wide`` that have the same number of digits."""
    for size in sorted({len(str(r)) for r in reps}):
        own = [r for r in reps if len(str(r)) == size]
        for at in range(0, len(own), wide):
            yield own[at : at + wide]


def _packed(times: np.ndarray) -> bytes:
    """Counts as a byte each, or as four where one isn't enough; the first byte says which."""
    return b"\1" + times.astype(np.uint8).tobytes() if times.max() < 256 else b"\4" + times.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint32, offset=1)


def _counted(by: list[str], kinds: list, seed: int):
    """Rows (strategy, rep, sets: by and k) to rows by, strategy, block, rep, times: how often each member of a block is drawn."""
    schema = pa.schema([*(pa.field(b, to_arrow_type(k)) for b, k in zip(by, kinds, strict=True)), ("strategy", pa.string()), ("block", pa.int64()), ("rep", pa.int32()), ("times", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units: dict[str, list[int]] = {}
            sets: dict[str, list[dict]] = {}
            for strategy, rep, own in zip(*(batch.column(c) for c in ("strategy", "rep", "sets")), strict=True):
                units.setdefault(strategy.as_py(), []).append(rep.as_py())
                if strategy.as_py() not in sets:
                    sets[strategy.as_py()] = own.as_py()
            for strategy, reps in units.items():
                own, most = sets[strategy], max(s["k"] for s in sets[strategy])
                room = sum(s["k"] for s in own)
                for some in _even(reps, max(1, min(8, (1 << 22) // room))):
                    yield from drawn(strategy, some, own, most)

    def drawn(strategy: str, reps: list[int], own: list[dict], most: int) -> Iterator[pa.RecordBatch]:
        times = [np.zeros((len(reps), s["k"]), np.uint32) for s in own]
        step = max(1, WIDE // len(reps))
        for first in range(1, most + 1, step):
            keys = heads(_prefixes(seed, "boot", strategy, reps), Tails.numbers(first, min(most, first + step - 1)), both=True) >> np.uint64(16)
            for s, t in zip(own, times, strict=True):
                places = (keys[:, : max(0, s["k"] - first + 1)] % np.uint64(s["k"])).astype(np.int64)
                for i in range(len(reps)):
                    np.add.at(t[i], places[i], 1)
        for s, t in zip(own, times, strict=True):
            for i, rep in enumerate(reps):
                parts = [_packed(t[i, at : at + BLOCK]) for at in range(0, s["k"], BLOCK)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([*(pa.array([s[b]] * n, schema.field(b).type) for b in by), pa.array([strategy] * n), pa.array(range(n), pa.int64()), pa.array([rep] * n, pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return scan


def bootstrap_sums(sets: DataFrame, table: DataFrame, taus: list[float], repeats: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, tau, strategy, rep and n, d, s, r: how many rows, and sums of degree, inter_deg and ratio over them, of every resampled set.

    table: ``node_values``. A task counts how often some repetitions draw each member, 4 bytes a member; counts of a block of
    members then meet the members' values, all repetitions at once.
    """
    kinds = [sets.schema[b].dataType for b in by]
    own = [*by, "strategy"]
    names = _sum_columns(taus)
    keys = ", ".join(f"{b} {k.simpleString()}" for b, k in zip(by, kinds, strict=True)) + (", " if by else "")
    sizes = sets.groupBy(*own).agg(F.count(F.lit(1)).alias("k")).groupBy("strategy").agg(F.collect_list(F.struct(*by, "k")).alias("sets"))
    units = sizes.select("strategy", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"), "sets").repartition(_tasks(sets), "strategy", "rep")
    counts = units.mapInArrow(_counted(list(by), kinds, seed), f"{keys}strategy string, block long, rep int, times binary")
    members = sets.join(table, [*by, "node"]).withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).select(*own, "block", "place", "degree", *(f"x{i}" for i in range(len(taus))))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(out.names, out.types, strict=True)})
        at = right.column("place").to_numpy() % BLOCK
        values = _values(right, len(taus))
        sums = np.empty((left.num_rows, values.shape[1]))
        for i, times in enumerate(left.column("times")):
            sums[i] = _unpacked(times.as_py())[at] @ values
        first = left.slice(0, 1)
        return pa.table([*(pa.concat_arrays([pa.array(first.column(b).to_pylist() * left.num_rows, out.field(b).type)]) for b in own), left.column("rep").combine_chunks(), *_sums(sums)], schema=out)

    out = pa.schema([*(pa.field(b, to_arrow_type(k)) for b, k in zip(by, kinds, strict=True)), ("strategy", pa.string()), ("rep", pa.int32()), *((n, pa.int64() if t == "long" else pa.float64()) for n, t in names)])
    ddl = f"{keys}strategy string, rep int, " + ", ".join(f"{n} {t}" for n, t in names)
    parts = counts.groupBy(*own, "block").cogroup(members.groupBy(*own, "block")).applyInArrow(summed, ddl)
    return by_tau(parts.groupBy(*own, "rep").agg(*[F.sum(n).alias(n) for n, _ in names]), [*own, "rep"], taus)


def _brackets(need: DataFrame, quartiles: DataFrame, by: tuple[str, ...], slack: float) -> DataFrame:
    """by, strategy, bin, need, low, high: of uniform 32-bit keys of the bin's nodes, those below ``low`` almost surely
    belong to the ``need`` smallest, and those from ``high`` on almost surely don't."""
    pools = quartiles.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("pool"))
    share = F.col("need") / F.col("pool")
    # standard deviations, and what small numbers add to them
    off = slack * F.sqrt(share * (1 - share) / F.col("pool")) + slack * slack / F.col("pool")
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * F.lit(2.0**32)
    low = F.when(F.col("need") >= F.col("pool"), F.lit(2**32)).otherwise(F.floor(at(share - off)))
    return need.join(pools, [*by, "bin"]).select(*by, "strategy", "bin", "need", low.cast("long").alias("low"), F.ceil(at(share + off)).cast("long").alias("high"))


def _selected(by: list[str], strategies: list[str], bins: list[str], n_taus: int, repeats: int, seed: int, schema: pa.Schema):
    """Nodes with the brackets of their bins to rows of three kinds: sums over the sure ones of a repetition, how many of
    each bin these are, and the nodes between the brackets."""
    blank = {f.name: f.type for f in schema}

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in blank.items()], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                yield from drawn(pa.Table.from_batches([batch]), held)
            if len(held) > HELD:
                yield from told(held)
                held.clear()
        yield from told(held)

    def told(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        reps = pa.array(range(1, repeats + 1), pa.int32())
        for (graph, s), sums in held.items():
            own = {**{b: pa.array([x] * repeats, blank[b]) for b, x in zip(by, graph, strict=True)}, "strategy": pa.array([strategies[s]] * repeats), "rep": reps}
            yield rows(repeats, **own, **dict(zip([n for n, _ in _sum_columns([0.0] * n_taus)], _sums(sums[:, len(bins) :]), strict=True)))
            for i, name in enumerate(bins):
                yield rows(repeats, **own, bin=pa.array([name] * repeats), sure=pa.array(np.rint(sums[:, i]).astype(np.int64)))

    def drawn(table: pa.Table, held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # nodes of several graphs share their digests; they come in order
        text = table.column("text").combine_chunks()
        texts = text.dictionary_encode() if by else None
        tails, at = (Tails.of(texts.dictionary), texts.indices.to_numpy()) if by else (Tails.of(text), None)
        graphs: dict[tuple, list[int]] = {}
        for i, g in enumerate(zip(*(table.column(b).to_pylist() for b in by), strict=True)) if by else ():
            graphs.setdefault(g, []).append(i)
        groups = {g: np.array(x) for g, x in graphs.items()} if by else {(): slice(None)}
        bin_of = np.array([bins.index(b) for b in table.column("bin").to_pylist()])
        values = np.concatenate([(bin_of[:, None] == np.arange(len(bins))).astype(np.float64), _values(table, n_taus)], 1)
        for s, strategy in enumerate(strategies):
            low, high = (table.column(f"{c}_{s}").to_numpy() for c in ("low", "high"))
            every, none, last = low >= 2**32, (low == 0) & (high == 0), (np.maximum(high, 1) - 1).astype(np.uint32)
            if none.all():
                continue
            first = np.minimum(low, 2**32 - 1).astype(np.uint32)
            between = ~every & ~none
            for reps in _even(list(range(1, repeats + 1)), max(1, WIDE // len(tails))):
                keys = heads(_prefixes(seed, "perm", strategy, reps), tails)
                keys = keys[:, at] if by else keys
                sure = keys < first
                if every.any():
                    sure |= every
                for g, own in groups.items():
                    sums = held.get((g, s))
                    if sums is None:
                        sums = held[g, s] = np.zeros((repeats, values.shape[1]))
                    sums[reps[0] - 1 : reps[-1]] += sure[:, own].astype(np.float64) @ values[own]
                near = ~sure & (keys <= last) & between
                r, i = np.nonzero(near)
                for a in range(0, len(r), 10_000):
                    rr, ii = r[a : a + 10_000], i[a : a + 10_000]
                    picked = table.take(pa.array(ii)).combine_chunks()
                    own = {c: picked.column(c).combine_chunks() for c in (*by, "node", "bin", "degree", *(f"x{t}" for t in range(n_taus)))}
                    yield rows(len(rr), **own, strategy=pa.array([strategy] * len(rr)), rep=pa.array(rr + reps[0], pa.int32()), key=pa.array(keys[rr, ii].astype(np.int64)))

    return scan


def null_sums(need: DataFrame, quartiles: DataFrame, table: DataFrame, taus: list[float], repeats: int, seed: int, by: tuple[str, ...] = (), slack: float | None = None) -> DataFrame:
    """by, tau, strategy, rep and n, d, s, r (as ``bootstrap_sums``) of the ``need`` nodes of each bin with the smallest keys.

    table: ``node_values``. A single pass over nodes works out the first 32 bits of all keys. Where the last of the
    smallest lies is known within ``slack`` standard deviations: nodes before are summed as they are, and only those
    around it (of n nodes, some multiple of the root of n) are sorted, by whole keys. Repetitions whose last node lies
    elsewhere, hardly ever one, are drawn again by sorting, so that the result is exact.
    """
    own, n_taus = [*by, "strategy"], len(taus)
    names, marks = _sum_columns(taus), [f"x{i}" for i in range(len(taus))]
    strategies = sorted(r.strategy for r in need.select("strategy").distinct().collect())
    if not strategies:
        return need.select(*own).crossJoin(need.sparkSession.createDataFrame([], "tau double, rep int, n long, d long, s long, r double"))
    bins = sorted(r.bin for r in need.select("bin").distinct().collect())
    limits = _brackets(need, quartiles, by, SLACK if slack is None else slack)
    at = [F.coalesce(F.max(F.when(F.col("strategy") == s, F.col(c))), F.lit(0).cast("long")).alias(f"{c}_{i}") for i, s in enumerate(strategies) for c in ("low", "high")]
    rows = table.join(limits.groupBy(*by, "bin").agg(*at), [*by, "bin"]).withColumn("text", F.col("node").cast("string"))
    dealt = rows.repartition(_tasks(table), "node")
    dealt = dealt.sortWithinPartitions("node") if by else dealt
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"strategy string, rep int, bin string, sure long, node {kinds['node']}, key long, degree long", *(f"{m} long" for m in marks), *(f"{n} {t}" for n, t in names)])
    types = {f.name: f.dataType for f in rows.schema}
    schema = pa.schema([*((b, to_arrow_type(types[b])) for b in by), ("strategy", pa.string()), ("rep", pa.int32()), ("bin", pa.string()), ("sure", pa.int64()), ("node", to_arrow_type(types["node"])), ("key", pa.int64()), ("degree", pa.int64()), *((m, pa.int64()) for m in marks), *((n, pa.int64() if t == "long" else pa.float64()) for n, t in names)])
    out = written(dealt.mapInArrow(_selected(list(by), strategies, bins, n_taus, repeats, seed, schema), ddl), "null-parts")
    sure = out.where("sure IS NOT NULL").groupBy(*own, "rep", "bin").agg(F.sum("sure").alias("sure"))
    near = out.where("key IS NOT NULL")
    # four bins for each repetition from here on
    found = near.groupBy(*own, "rep", "bin").agg(F.count(F.lit(1)).alias("near"))
    left = need.join(sure, [*own, "bin"]).join(found, [*own, "rep", "bin"], "left").select(*own, "rep", "bin", (F.col("need") - F.col("sure")).alias("left"), F.coalesce("near", F.lit(0)).alias("near"))
    left = written(left, "left")
    missed = written(left.where("left < 0 OR left > near").select(*own, "rep").distinct(), "missed")
    place = F.row_number().over(Window.partitionBy(*own, "rep", "bin").orderBy("key", draw_key(seed, "perm", F.col("strategy"), F.col("rep"), F.col("node")), "node"))
    last = near.join(left.where("left > 0").drop("near"), [*own, "rep", "bin"]).withColumn("place", place).where("place <= left")
    sums = out.where("n0 IS NOT NULL").select(*own, "rep", *(n for n, _ in names))
    if not missed.isEmpty():
        pool = table.join(need, [*by, "bin"]).join(missed, own)
        keyed = pool.withColumn("key", draw_key(seed, "perm", F.col("strategy"), F.col("rep"), F.col("node")))
        again = first_in(keyed, (*own, "rep", "bin"), "key", "node", "need")
        last = last.join(missed, [*own, "rep"], "left_anti").select(*own, "rep", "degree", *marks).unionByName(again.select(*own, "rep", "degree", *marks))
        sums = sums.join(missed, [*own, "rep"], "left_anti")
    each = []
    for i, m in enumerate(marks):
        there = F.when(F.col(m).isNotNull(), 1).otherwise(0)
        each += [F.sum(there).cast("long"), F.sum(there * F.col("degree")), F.coalesce(F.sum(m), F.lit(0)), F.coalesce(F.sum(F.col(m) / F.greatest(F.lit(1), F.col("degree"))), F.lit(0.0))]
    held = last.groupBy(*own, "rep").agg(*[e.cast(t).alias(n) for e, (n, t) in zip(each, names, strict=True)])
    return by_tau(sums.unionByName(held).groupBy(*own, "rep").agg(*[F.sum(n).alias(n) for n, _ in names]), [*own, "rep"], taus)
