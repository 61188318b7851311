"""Spans of equal depth that split a hot key over many tasks without changing any result.

A window ``partitionBy(key)`` sorts all rows of a key in one task. The rows of a key with very
many are cut into spans along their full ordering (time, then tie-breaks), the window runs
per (key, span), and what crosses a span border is carried by one small row per span.

Spark's own range partitioning would draw new borders each time a plan reads it, so the rows and
what is carried between spans could disagree; a span here follows from the row and the data alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cdcflow.functions.columns import fresh

SPAN, HOT = "_span", "_hot"
# Keys that are split, and cut points of all of them together. A key that is not among the most
# frequent ones holds less than one row in so many, a span about as much at most.
MOST = 4096
# Cut points are searched in two steps of so many.
FAN = 64


@dataclass(frozen=True)
class HotKeys:
    """``rows``: rows of one key that one task should sort, about. ``depth``: sampled rows of a span.

    One row in ``rows / depth``, chosen by a hash of key and ordering, is sampled; a key whose
    sample stands for more than ``rows`` gets a cut point after every ``depth`` sampled rows. So
    cut points follow the rows wherever they are, in bursts and within single instants too. Where
    this would give more than MOST cut points they stand further apart.
    """

    rows: int = 2_000_000
    depth: int = 64

    @property
    def step(self) -> int:
        return max(1, self.rows // self.depth)

    @property
    def every(self) -> int:
        return max(1, min(self.depth, self.rows // self.step))

    def possible(self, *frames: DataFrame) -> bool:
        """Whether the frames together may hold ``rows`` rows, by Spark's own estimate of their size.

        Rows that an ordering tells apart take eight bytes at least, about. What is smaller has no hot
        key and needs no sample; a wrong estimate costs balance, never rows.
        """
        return sum(map(estimated, frames)) > 8 * self.rows


DEFAULT = HotKeys()


def estimated(frame: DataFrame) -> float:
    """Bytes of the frame by Spark's own estimate, no bound where it gives none."""
    plan = getattr(frame, "_jdf", None)
    return float("inf") if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_spans(df: DataFrame, key: Sequence[str], order: Sequence[str], hot: HotKeys = DEFAULT) -> DataFrame:
    """Add ``_span`` (0 for ordinary keys, rising with the ordering for hot ones) and ``_hot``.

    Rows that are equal in the whole ordering stay in one span. Cut points, at most MOST, are
    broadcast; no row carries more than FAN of them, and it finds its span by halving.
    """
    place = F.struct(*order)
    upper, lower = _cuts(df, key, place, hot)
    first, second = ([f"_{side}{i}" for i in range(len(key))] for side in ("upper", "lower"))
    renamed = lambda cuts, names: cuts.withColumnsRenamed(dict(zip((f"_key{i}" for i in range(len(key))), names)))
    matches = lambda names: [F.col(k) == F.col(n) for k, n in zip(key, names)]
    found = df.join(F.broadcast(renamed(upper, first)), matches(first), "left").withColumn("_passed", _passed("_upper", place))
    found = found.join(F.broadcast(renamed(lower, second)), [*matches(second), F.col("_passed") == F.col("_block")], "left")
    return found.withColumns(
        {
            HOT: F.col("_upper").isNotNull() | F.col("_lower").isNotNull(),
            SPAN: F.col("_passed") * FAN + _passed("_lower", place),
        }
    ).select(*df.columns, HOT, SPAN)


def _cuts(df: DataFrame, key: Sequence[str], place: Column, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Every FAN-th cut point of each hot key, and for each block between two of these those inside.

    The sample of a hot key is sorted, not gathered.
    """
    names = [f"_key{i}" for i in range(len(key))]
    sample = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)], place.alias("_place"))
    for n in names:
        sample = sample.filter(F.col(n).isNotNull())
    if hot.step > 1:
        sample = sample.filter(F.pmod(F.xxhash64(*names, "_place"), F.lit(hot.step)) == 0)
    many = sample.groupBy(*names).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot.every)
    most = many.orderBy(F.desc("_n"), *names).limit(MOST)
    apart = F.greatest(F.lit(hot.every), F.ceil(F.sum("_n").over(Window.partitionBy()) / MOST)).alias("_apart")
    hot_keys = most.select(*[F.col(n).alias(f"_hot{n}") for n in names], apart)
    ranked = sample.join(F.broadcast(hot_keys), [F.col(n) == F.col(f"_hot{n}") for n in names]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*names).orderBy("_place"))
    )
    # A cut point begins a span: the row after ``_apart`` others.
    number = ((F.col("_rank") - 1) / F.col("_apart")).cast("int")
    cuts = ranked.filter((F.col("_rank") > 1) & ((F.col("_rank") - 1) % F.col("_apart") == 0)).select(*names, "_place", number.alias("_number"))
    inner = F.col("_number") % FAN != 0
    places = F.array_sort(F.collect_list("_place"))
    upper = cuts.filter(~inner).groupBy(*names).agg(places.alias("_upper"))
    lower = cuts.filter(inner).groupBy(*names, (F.col("_number") / FAN).cast("int").alias("_block")).agg(places.alias("_lower"))
    return upper, lower


def _passed(cuts: str, place: Column) -> Column:
    """How many of the sorted cut points (at most FAN, or NULL) are not after ``place``."""
    steps = F.array(*[F.lit(FAN >> i) for i in range(FAN.bit_length())])
    further = lambda n, step: F.coalesce(F.get(cuts, n + step - 1) <= place, F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when(further(n, step), n + step).otherwise(n))
    return F.when(F.col(cuts).isNull(), 0).otherwise(found)


def _dealt(df: DataFrame, key: Sequence[str], order: Sequence[str], hot: HotKeys) -> DataFrame:
    """Rows with their span, each span on a task of its own.

    Said explicitly: rows may be dealt by key already, and a window over key and span would be
    content with that and leave a hot key where it is.
    """
    return with_spans(df, key, order, hot).repartition(*key, SPAN)


def next_time(
    df: DataFrame, key: Sequence[str], order: Sequence[str], out: str, hot: HotKeys | None = DEFAULT
) -> DataFrame:
    """Add the time (``order[0]``) of the key's next row in ``order``, NULL for its last row.

    Pass ``hot=None`` only when the number of rows per key is known to be small. What is carried
    across borders, here and below, is one row for each span of a hot key, at most 2 * MOST.
    """
    at = order[0]
    if hot is None or not hot.possible(df):
        return df.withColumn(out, F.lead(at).over(Window.partitionBy(*key).orderBy(*order)))
    spanned = _dealt(df, key, order, hot)
    inside = spanned.withColumn(out, F.lead(at).over(Window.partitionBy(*key, SPAN).orderBy(*order)))
    starts = spanned.filter(HOT).groupBy(*key, SPAN).agg(F.min(at).alias("_start"))
    following = starts.select(
        *key, SPAN, F.lead("_start").over(Window.partitionBy(*key).orderBy(SPAN)).alias("_follow")
    )
    return (
        inside.join(F.broadcast(following), [*key, SPAN], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_follow")))
        .select(*df.columns, out)
    )


def last_seen(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    hot: HotKeys | None = DEFAULT,
    *,
    before: bool = False,
) -> DataFrame:
    """Add the latest non-NULL ``value`` up to and including each row in ``order``, or ``before`` it."""
    last = -1 if before else Window.currentRow
    ordered = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    if hot is None or not hot.possible(df):
        return df.withColumn(out, F.last(value, ignorenulls=True).over(ordered(*key)))
    (held,) = fresh(df, "_held")
    spanned = _dealt(df.withColumn(held, F.col(value) if isinstance(value, str) else value), key, order, hot)
    inside = spanned.withColumn(out, F.last(held, ignorenulls=True).over(ordered(*key, SPAN)))
    ends = (
        spanned.filter(HOT)
        .groupBy(*key, SPAN)
        .agg(F.max_by(held, F.when(F.col(held).isNotNull(), F.struct(*order))).alias("_end"))
    )
    earlier = Window.partitionBy(*key).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, SPAN, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        inside.join(F.broadcast(carried), [*key, SPAN], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .select(*df.columns, out)
    )


def neighbours(
    df: DataFrame, key: Sequence[str], order: Sequence[str], state: Column, hot: HotKeys | None = DEFAULT
) -> DataFrame:
    """Add ``_next``, the time (``order[0]``) of the key's next row, and ``_last``, the ``state`` of the one before.

    Both come from one cut into spans, whose first times and last states cross the borders.
    """
    at = order[0]
    if hot is None or not hot.possible(df):
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumns({"_next": F.lead(at).over(w), "_last": F.lag(state).over(w)})
    spanned = _dealt(df.withColumn("_state", state), key, order, hot)
    w = Window.partitionBy(*key, SPAN).orderBy(*order)
    inside = spanned.withColumns({"_next": F.lead(at).over(w), "_last": F.lag("_state").over(w)})
    borders = (
        spanned.filter(HOT)
        .groupBy(*key, SPAN)
        .agg(F.min(at).alias("_start"), F.max_by("_state", F.struct(*order)).alias("_end"))
    )
    spans = Window.partitionBy(*key).orderBy(SPAN)
    carried = borders.select(*key, SPAN, F.lead("_start").over(spans).alias("_follow"), F.lag("_end").over(spans).alias("_carry"))
    return (
        inside.join(F.broadcast(carried), [*key, SPAN], "left")
        .withColumns({"_next": F.coalesce("_next", "_follow"), "_last": F.coalesce("_last", "_carry")})
        .select(*df.columns, "_next", "_last")
    )
