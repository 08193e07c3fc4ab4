"""Mergeable quantile sketches with relative rank error (relative compactors).

A sketch is a set of levels; an item of level h stands for 2**h values. A level over its capacity
compacts: the part near the protected tail stays, the rest is halved and promoted. Compacting more
of the unprotected side only at every second, fourth ... compaction keeps the error at rank r
proportional to the distance from the protected end, so extreme percentiles stay exact-like.
Sketches of partitions or days merge by concatenating levels and compacting again.

Tables of sketches have one row per key: ``items`` and the level of each in ``levels``, and the
compaction counter of every level in ``steps``, of a sketch that protects the high tail; ``low_items`` and
so on are of one that protects the low tail. A sketch of at most ``capacity(0)`` items was never compacted
and is exact, then the low columns are null and the others serve both tails. Which half survives is
decided by a hash of counter and level, never by a random generator.

Rows are sorted by key within a task before they are sketched, so a task holds one key's sketches at a
time and hands on one row a key, whatever the number and order of keys. Rows of a key are merged as a
tree of ``FAN`` rows each, so no row ever holds more than ``FAN`` sketches.

Defined cases: null and NaN values are left out; infinities count as values; groups without values
and empty tables give no row; the null group is a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = 24  # values in a section; the error falls as its inverse
FAN = 64  # sketches merged into one at a time
NAMES = ("levels", "items", "steps", "low_levels", "low_items", "low_steps")
BODY = [T.StructField(n, T.ArrayType(t)) for n, t in zip(NAMES, (T.IntegerType(), T.DoubleType(), T.LongType()) * 2)]
SLOT = T.StructField("slot_", T.IntegerType())


def capacity(steps: int, section: int = SECTION) -> int:
    """Twice the sections that ``steps`` compactions call for; sections double as counters grow."""
    sections = 3 + max(0, int(steps).bit_length() - 3)
    return 2 * section * sections


def _coin(steps: int, level: int) -> int:
    x = (steps * 0x9E3779B97F4A7C15 + level * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return ((x * 0xD6E8FEB86659FD93) >> 63) & 1


class Sketch:
    """One key's levels; ``protect`` names the tail ('high' or 'low') that keeps exact ranks longest."""

    def __init__(self, section: int = SECTION, protect: str = "high") -> None:
        if protect not in ("high", "low"):
            raise ValueError("protect must be 'high' or 'low'")
        self.section, self.protect = section, protect
        self.levels: list[np.ndarray] = []
        self.steps: list[int] = []

    def _at(self, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
            self.steps.append(0)

    def add(self, values: np.ndarray, weights: np.ndarray | None = None) -> None:
        """Add values; a weight is spread over the levels of its binary digits."""
        values = np.asarray(values, dtype=float)
        if weights is None:
            self.put(0, values)
        else:
            weights = np.asarray(weights, dtype=np.int64)
            for level in range(int(weights.max(initial=0)).bit_length()):
                chosen = values[(weights >> level) & 1 == 1]
                if len(chosen):
                    self.put(level, chosen)
        self.compact()

    def put(self, level: int, items: np.ndarray, steps: int = 0) -> None:
        self._at(level)
        self.levels[level] = np.concatenate([self.levels[level], items])
        self.steps[level] |= steps

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) > capacity(self.steps[level], self.section):
                self._compact_level(level)
            level += 1

    def _compact_level(self, level: int) -> None:
        steps = self.steps[level]
        items = np.sort(self.levels[level])
        if self.protect == "low":
            items = items[::-1]
        # of the half that may be compacted: one section, and one more for each trailing one of the counter
        keep = capacity(steps, self.section) // 2
        sections = 1
        while steps >> (sections - 1) & 1:
            sections += 1
        spared = max(0, keep - sections * self.section)
        take = len(items) - keep - spared
        take -= take & 1
        low, rest = items[:take], items[take:]
        promoted = low[_coin(steps, level)::2]
        self.levels[level] = rest
        self.steps[level] = steps + 1
        self._at(level + 1)
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], promoted])

    @classmethod
    def of(cls, levels: np.ndarray, items: np.ndarray, steps: np.ndarray, section: int, protect: str) -> Sketch:
        s = cls(section, protect)
        for h in range(max(int(levels.max(initial=-1)) + 1, len(steps))):
            s.put(h, items[levels == h], int(steps[h]) if h < len(steps) else 0)
        s.compact()
        return s

    def body(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels, items, steps), the columns of a row."""
        levels = np.concatenate([np.full(len(x), h, dtype=np.int32) for h, x in enumerate(self.levels)]) if self.levels else np.empty(0, np.int32)
        return levels, np.concatenate(self.levels) if self.levels else np.empty(0), np.asarray(self.steps, dtype=np.int64)

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels) if self.levels else np.empty(0)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)]) if self.levels else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]

    def quantiles(self, ps: Sequence[float]) -> list[float]:
        """The smallest item whose cumulative weight reaches ``p`` of the total (rank max(1, ceil(p*n)))."""
        values, weights = self.weighted()
        if not len(values):
            return [float("nan")] * len(ps)
        running = np.cumsum(weights)
        at = np.searchsorted(running, np.maximum(1, np.ceil(np.asarray(ps) * running[-1] - 1e-9)))
        return [float(v) for v in values[np.minimum(at, len(values) - 1)]]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


class Both:
    """A key's values: kept as they are up to the first capacity, then in one sketch for each tail."""

    def __init__(self, section: int) -> None:
        self.section, self.raw, self.high, self.low = section, Sketch(section), None, None

    def add(self, values: np.ndarray, weights: np.ndarray) -> None:
        if self.high is None:
            room, held = capacity(0, self.section), sum(map(len, self.raw.levels))
            if held + sum(bin(int(w)).count("1") for w in weights[:room + 1]) <= room and len(weights) <= room:
                self.raw.add(values, weights)  # within the room of one level, so nothing is compacted
                return
            levels, items, steps = self.raw.body()
            self.high, self.low = Sketch.of(levels, items, steps, self.section, "high"), Sketch.of(levels, items, steps, self.section, "low")
        self.high.add(values, weights)
        self.low.add(values, weights)

    def body(self) -> tuple:
        return (*self.raw.body(), None, None, None) if self.high is None else (*self.high.body(), *self.low.body())


def _shares(keys: list[str], section: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key of batches in which equal keys stand together."""
    slot = TaskContext.get().partitionId() if TaskContext.get() else 0
    open_key: tuple | None = None
    held: Both | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        values, weights = pdf["value_"].to_numpy(), pdf["weight_"].to_numpy()
        heads = [tuple(None if pd.isna(x) else x for x in row) for row in pdf[keys].iloc[starts].itertuples(index=False, name=None)]
        out, room = [], capacity(0, section)
        single = np.maximum.reduceat(weights, starts) == 1
        for key, i, j, once in zip(heads, starts, ends, single):
            if once and j - i <= room and j < len(code) and key != open_key:  # a whole key, exact as it stands
                if held is not None:
                    out.append((*open_key, *held.body(), slot))
                    open_key, held = None, None
                out.append((*key, np.zeros(j - i, np.int32), values[i:j], [], None, None, None, slot))
                continue
            if held is None or key != open_key:
                if held is not None:
                    out.append((*open_key, *held.body(), slot))
                open_key, held = key, Both(section)
            held.add(values[i:j], weights[i:j])
        if out:
            yield pd.DataFrame(out, columns=[*keys, *NAMES, "slot_"])
    if held is not None:
        yield pd.DataFrame([(*open_key, *held.body(), slot)], columns=[*keys, *NAMES, "slot_"])


def build(df: DataFrame, keys: Sequence[str], value: str, section: int = SECTION) -> DataFrame:
    """Sketches of ``value`` per key.

    Equal values are counted map-side first and hash-partitioned by key *and* value, which spreads a
    hot key over all tasks; each task sketches its share of such a key, and shares merge by key.
    """
    keys = list(keys)
    schema = T.StructType(_key_fields(df, keys) + BODY + [SLOT])
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("value_")).where("value_ is not null and not isnan(value_)")
        .groupBy(*keys, "value_").agg(F.count("*").alias("weight_")).sortWithinPartitions(*keys)
    )
    shares = counted.mapInPandas(partial(_shares, keys, section), schema)
    slots = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    while slots > FAN:  # tasks beyond the fan: merge neighbours first
        shares = _merged(shares.withColumn("slot_", (F.col("slot_") / FAN).cast("int")), [*keys, "slot_"], section)
        slots = -(-slots // FAN)
    return _merged(shares.drop("slot_"), keys, section)


def merge(sketches: DataFrame, keys: Sequence[str], section: int = SECTION) -> DataFrame:
    """Merge every sketch that shares ``keys`` (fewer than the sketches were built by, if wanted).

    A key's sketches are first merged in ``FAN`` parts, by hash, then these into one.
    """
    keys = list(keys)
    parts = sketches.withColumn("slot_", F.pmod(F.xxhash64(*[c for c in sketches.columns if c not in NAMES]), F.lit(FAN)).cast("int"))
    finer = len(sketches.columns) - len(NAMES) > len(keys)
    return _merged(_merged(parts.select(*keys, "slot_", *NAMES), [*keys, "slot_"], section).drop("slot_") if finer else sketches.select(*keys, *NAMES), keys, section)


def _merged(sketches: DataFrame, keys: list[str], section: int) -> DataFrame:
    """One row per key, levels concatenated by a JVM aggregate; only rows beyond a sketch's first capacity are compacted, in Arrow batches."""
    schema = T.StructType(_key_fields(sketches, keys) + BODY)
    either = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0))))
    rows = sketches.groupBy(*keys).agg(F.collect_list(F.struct(*NAMES)).alias("rows_"))
    sketched = F.exists("rows_", lambda r: r["low_items"].isNotNull())

    def joined(name: str, low: bool) -> list:
        pick = lambda r: F.coalesce(r[f"low_{name}"], r[name]) if low else r[name]
        every = F.transform("rows_", pick)
        out = F.aggregate(every, F.array().cast("array<bigint>"), either) if name == "steps" else F.flatten(every)
        return F.when(sketched | (F.aggregate("rows_", F.lit(0), lambda a, r: a + F.size(r["items"])) > capacity(0, section)), out) if low else out

    one = rows.select(*keys, *[joined(n.removeprefix("low_"), n.startswith("low_")).alias(n) for n in NAMES])

    def compacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = []
            for high, low in zip(zip(*(pdf[n] for n in NAMES[:3])), zip(*(pdf[n] for n in NAMES[3:]))):
                if low[1] is None:
                    bodies.append((*high, None, None, None))
                else:
                    bodies.append(tuple(x for (lv, xs, st), tail in ((high, "high"), (low, "low")) for x in Sketch.of(np.asarray(lv), np.asarray(xs, dtype=float), np.asarray(st), section, tail).body()))
            out = pdf[keys].copy()
            for i, name in enumerate(NAMES):
                out[name] = pd.Series([x[i] for x in bodies], index=out.index, dtype=object)
            yield out

    return one.mapInPandas(compacted, schema)


def quantiles(sketches: DataFrame, keys: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """(keys, n, one column per named percentile) from sketches, inside the JVM.

    A percentile is the smallest item whose cumulative weight reaches rank max(1, ceil(p * n)); those below
    the median are read from the sketch of the low tail, the others from that of the high tail.
    """
    keys = list(keys)
    weight = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h)
    pairs = lambda items, levels: F.sort_array(F.zip_with(items, levels, lambda x, h: F.struct(x.alias("v"), weight(h).alias("w"))))
    flat = sketches.select(*keys, pairs(F.col("items"), F.col("levels")).alias("high"), F.when(F.col("low_items").isNotNull(), pairs(F.col("low_items"), F.col("low_levels"))).alias("low_"))
    flat = flat.select(*keys, "high", F.coalesce("low_", "high").alias("low"), F.aggregate("high", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("n"))

    def found(pairs: str, names: list[str]):
        want = F.array(*[F.greatest(F.lit(1.0), F.ceil(F.lit(ps[k]) * F.col("n") - 1e-9)) for k in names])
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.transform(want, lambda w: F.lit(None).cast("double")).alias("found"))
        return F.aggregate(pairs, start, lambda a, x: F.struct(
            (a["seen"] + x["w"]).alias("seen"),
            F.zip_with(a["found"], want, lambda f, w: F.when(f.isNull() & (a["seen"] + x["w"] >= w), x["v"]).otherwise(f)).alias("found"),
        ))["found"]

    lows, highs = [k for k in ps if ps[k] < 0.5], [k for k in ps if ps[k] >= 0.5]
    picked = flat.select(*keys, "n", *[found(c, names).alias(c) for c, names in (("low", lows), ("high", highs)) if names])
    at = {k: F.col(c)[i] for c, names in (("low", lows), ("high", highs)) for i, k in enumerate(names)}
    return picked.select(*keys, "n", *[at[k].alias(k) for k in ps])
