"""De-duplication and type 2 history.

A history frame holds versions of each key with ``_effective_from``, ``_effective_to``
(NULL while open), ``_is_current`` and ``_ingested_at``. A version replaced at the instant
it began was never visible and is not kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from cdcflow.operators import skew

FROM, TO, CURRENT, INGESTED, OPERATION = "_effective_from", "_effective_to", "_is_current", "_ingested_at", "_operation"
VERSION_COLUMNS = [FROM, TO, CURRENT, INGESTED]
WRITTEN = ["INSERT", "UPDATE"]
# Bytes of staged changes, by Spark's own estimate, whose keys are too many to be broadcast.
LARGE = 32 << 20


def known_changes(changes: DataFrame) -> DataFrame:
    """Rows with a known operation; others must not displace a real change."""
    return changes.filter(F.col(OPERATION).isin(*WRITTEN, "DELETE"))


def latest_per_key(df: DataFrame, key: Sequence[str], ordering: Sequence[str]) -> DataFrame:
    """The last row of each key by ``ordering``.

    In this shape Spark keeps one row per key and task before the shuffle, so a hot key
    sends one row per task.
    """
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in ordering])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def add_version_columns(df: DataFrame, effective: Column, ingested: Column | None = None) -> DataFrame:
    """Mark rows as open versions; pass literals so that every plan sees the same time."""
    return df.withColumns(
        {
            FROM: effective,
            TO: F.lit(None).cast(_type_of(df, effective)),
            CURRENT: F.lit(True),
            INGESTED: effective if ingested is None else ingested,
        }
    )


def from_changelog(
    changes: DataFrame, key: Sequence[str], ordering: Sequence[str], hot: skew.HotKeys = skew.DEFAULT
) -> DataFrame:
    """Whole history of a change log; ``ordering[0]`` is the time of change.

    Every change ends its predecessor, a DELETE opens nothing. Changes without a whole key
    belong to no entity and take no part.
    """
    at = ordering[0]
    ended = skew.next_time(_keyed(known_changes(changes), key), key, ordering, TO, hot)
    return (
        ended.filter(F.col(OPERATION).isin(*WRITTEN))
        .withColumns({FROM: F.col(at), CURRENT: F.col(TO).isNull(), INGESTED: F.col(at)})
        .filter(F.col(TO).isNull() | (F.col(TO) > F.col(FROM)))
        .select(*changes.columns, *VERSION_COLUMNS)
    )


def apply_changes(
    target: DataFrame | None,
    staged: DataFrame,
    key: Sequence[str],
    *,
    order: Sequence[str] = (),
    initial: str = "upsert",
    hot: skew.HotKeys | None = None,
    keep_deletes: bool = False,
    deepest: int | None = None,
) -> DataFrame:
    """History after a batch of staged changes (rows with version columns).

    A changed key's versions that were valid at its first staged change or later are rebuilt
    together with the changes; all others pass through. A late change is placed between the
    versions around it, and applying a batch twice gives the same history. ``order`` breaks
    ties between staged changes of one key at one instant. With one staged change per key a
    key brings a handful of rows; give ``hot`` when a key may have very many. Where ``target`` and
    ``staged`` are known to hold at most ``deepest`` rows of any key together, no key is searched for
    or split: a lone row a key is its own version, and of many changes with a target each row is
    exchanged once, not for the join and again for the sort.

    A DELETE that ends no version is told by no row. With ``keep_deletes`` it stays as a
    marker (``_operation`` DELETE, ``_effective_from`` = ``_effective_to``), so that versions
    which arrive later still end there; give such a history back as the next ``target``, and
    read it through ``versions``.
    """
    key = list(key)
    staged = _keyed(known_changes(staged), key)
    few = deepest is not None and deepest <= (hot or skew.DEFAULT).rows
    if few:
        hot = None
    if target is None:
        if initial == "insert_only":
            staged = staged.filter(F.col(OPERATION) == "INSERT")
        columns = staged.columns
    else:
        columns = target.columns
    arriving = staged.select(*columns, F.col(FROM).alias("_at"), F.lit(2).alias("_kind"))
    if target is None:
        rebuilt = _rebuild(arriving, key, order, hot, columns, alone=few and deepest <= 1)
        return rebuilt if keep_deletes else versions(rebuilt)
    # The joins below hide how much is there at most.
    if hot is not None and not hot.possible(target, staged):
        hot = None
    # What ended before the first change of the whole batch takes no part: it is neither
    # joined nor shuffled, which leaves little more than the open versions.
    floor = staged.agg(F.min(FROM)).scalar()
    settled = F.col(TO).isNotNull() & F.coalesce(F.col(TO) < floor, F.lit(True))
    if few and skew.estimated(staged) > LARGE:
        merged = target.filter(settled).unionByName(_merged(target.filter(~settled), arriving, key, order, columns))
        return merged if keep_deletes else versions(merged)
    first = staged.groupBy(*key).agg(F.min(FROM).alias("_since"))
    matched = target.filter(~settled).join(first, key, "left")
    touched = F.coalesce((F.col(TO).isNull() & F.col("_since").isNotNull()) | (F.col(TO) >= F.col("_since")), F.lit(False))
    # A version's end is an event of its own: a DELETE leaves no other row that tells of it.
    begins = F.struct(F.col(FROM).alias("_at"), F.when(F.col(OPERATION) == "DELETE", 0).otherwise(1).alias("_kind"))
    ends = F.when(F.col(TO) > F.col(FROM), F.struct(F.col(TO).alias("_at"), F.lit(0).alias("_kind")))
    old = matched.filter(touched).select(*columns, F.inline(F.array(begins, ends))).filter(F.col("_kind").isNotNull())
    kept = target.filter(settled).unionByName(matched.filter(~touched).select(*columns))
    merged = kept.unionByName(_rebuild(old.unionByName(arriving), key, order, hot, columns))
    return merged if keep_deletes else versions(merged)


def versions(history: DataFrame) -> DataFrame:
    """The history without markers of DELETEs that ended no version."""
    return history.filter(F.col(OPERATION) != "DELETE")


def drop_unchanged(
    target: DataFrame,
    staged: DataFrame,
    key: Sequence[str],
    values: Sequence[str],
    order: Sequence[str] = (),
    hot: skew.HotKeys | None = None,
) -> DataFrame:
    """Staged rows without the UPDATEs that repeat what their key held just before.

    That is the staged change before it, else the version valid then; a late change is not
    compared with today's version. Values are compared one by one, NULL equal to NULL.
    """
    key = list(key)
    if hot is not None and not hot.possible(target, staged):
        hot = None
    held = F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    first = staged.groupBy(*key).agg(F.min(FROM).alias("_since"))
    near = target.join(first, key).filter(F.col(TO).isNull() | (F.col(TO) > F.col("_since")))
    state = lambda alive: F.struct(alive.alias("alive"), held.alias("held"))
    begins = F.struct(F.col(FROM).alias("_at"), F.lit(1).alias("_kind"), state(F.col(OPERATION) != "DELETE").alias("_state"))
    ends = F.when(
        F.col(TO) > F.col(FROM), F.struct(F.col(TO).alias("_at"), F.lit(0).alias("_kind"), state(F.lit(False)).alias("_state"))
    )
    ties = [c for c in order if c in staged.columns]
    old = near.select(*key, F.inline(F.array(begins, ends))).filter(F.col("_kind").isNotNull())
    new = staged.select(
        *key, F.col(FROM).alias("_at"), F.lit(2).alias("_kind"), state(F.col(OPERATION) != "DELETE").alias("_state"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], F.struct(*staged.columns).alias("_row"),
    )
    events = new.unionByName(old, allowMissingColumns=True)
    # An end and the version that begins there are one instant: the later of them tells the state.
    sequence = ["_at", "_kind", *[f"_tie{i}" for i in range(len(ties))]]
    seen = skew.last_seen(events, key, sequence, "_state", "_before", hot, before=True).filter(F.col("_kind") == 2)
    repeats = F.coalesce(F.col("_before.alive"), F.lit(False)) & F.col("_before.held").eqNullSafe(F.col("_state.held"))
    return seen.filter(~((F.col(f"_row.{OPERATION}") == "UPDATE") & repeats)).select("_row.*")


def current(history: DataFrame) -> DataFrame:
    return history.filter(F.col(CURRENT))


def timeline(history: DataFrame, condition: Column | None = None) -> DataFrame:
    """Versions in order of time, of the keys that satisfy ``condition``."""
    return (history if condition is None else history.filter(condition)).orderBy(FROM)


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """Versions valid at ``moment``."""
    return history.filter((F.col(FROM) <= moment) & (F.col(TO).isNull() | (F.col(TO) > moment)))


def as_of_join(
    facts: DataFrame,
    history: DataFrame,
    fact_key: Sequence[str],
    key: Sequence[str],
    fact_time: str,
    values: Sequence[str],
    *,
    how: str = "inner",
    hot: skew.HotKeys = skew.DEFAULT,
) -> DataFrame:
    """Facts with ``values`` of the version valid at their own time.

    Facts and versions are sorted together by key and time and the last version seen is
    carried forward: one shuffle, and no pairing of all facts with all versions of a key.
    Facts without a whole key have no version and are not sorted at all.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    names = [f"_k{i}" for i in range(len(key))]
    fact_keys = [F.col(c).alias(n) for c, n in zip(fact_key, names)]
    version_keys = [F.col(c).alias(n) for c, n in zip(key, names)]
    version = F.struct(*values, FROM, TO)
    left = _keyed(facts, fact_key).select(
        *fact_keys, F.col(fact_time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact")
    )
    right = _keyed(history, key).select(
        *version_keys, F.col(FROM).alias("_at"), F.lit(0).alias("_kind"), version.alias("_version")
    )
    events = left.unionByName(right, allowMissingColumns=True)
    seen = skew.last_seen(events, names, ["_at", "_kind"], "_version", "_seen", hot).filter(F.col("_kind") == 1)
    valid = F.col("_seen").isNotNull() & (F.col("_seen")[TO].isNull() | (F.col("_seen")[TO] > F.col("_at")))
    picked = [F.when(valid, F.col("_seen")[v]).alias(v) for v in values]
    if how == "inner":
        return seen.filter(valid).select("_fact.*", *picked)
    found = seen.select("_fact.*", *picked)
    keyless = F.lit(False)
    for c in fact_key:
        keyless = keyless | F.col(c).isNull()
    empty = [F.lit(None).cast(found.schema[-len(values) + i].dataType).alias(v) for i, v in enumerate(values)]
    return found.unionAll(facts.filter(keyless).select(*facts.columns, *empty))


def counts_by_state(tables: dict[str, DataFrame]) -> DataFrame:
    """Current and closed versions of several tables."""
    parts = [
        history.agg(
            F.count_if(F.col(CURRENT)).alias("current_records"), F.count_if(~F.col(CURRENT)).alias("historical_records")
        ).select(F.lit(name).alias("table_name"), "current_records", "historical_records")
        for name, history in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def operation_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(OPERATION).agg(F.count("*").alias("count"))


def register_views(spark: SparkSession, name: str, history: DataFrame) -> None:
    """Expose a history to SQL as ``name``, ``name_history`` and ``name_current``."""
    history.createOrReplaceTempView(name)
    history.createOrReplaceTempView(f"{name}_history")
    current(history).createOrReplaceTempView(f"{name}_current")


def _keyed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    for k in key:
        df = df.filter(F.col(k).isNotNull())
    return df


def _merged(target: DataFrame, arriving: DataFrame, key: list[str], order: Sequence[str], columns: list[str]) -> DataFrame:
    """What the join in ``apply_changes`` gives, for few rows a key: both sides meet in one exchange by key.

    Rows that no change touches pass in a window of their own.
    """
    known = target.select(*columns, F.col(FROM).alias("_at"), F.lit(1).alias("_kind"))
    old = F.col("_kind") == 1
    since = F.min(F.when(~old, F.col(FROM))).over(Window.partitionBy(*key))
    touched = F.coalesce((F.col(TO).isNull() & F.col("_since").isNotNull()) | (F.col(TO) >= F.col("_since")), F.lit(False))
    begins = F.struct("_at", F.when(old & touched & (F.col(OPERATION) == "DELETE"), 0).otherwise(F.col("_kind")).alias("_kind"))
    ends = F.when(old & touched & (F.col(TO) > F.col(FROM)), F.struct(F.col(TO).alias("_at"), F.lit(0).alias("_kind")))
    met = known.unionByName(arriving).withColumn("_since", since)
    events = met.select(*columns, (old & ~touched).alias("_passes"), F.inline(F.array(begins, ends)))
    return _rebuild(events.filter(F.col("_kind").isNotNull()), key, order, None, columns, passes="_passes")


def _rebuild(
    events: DataFrame,
    key: list[str],
    order: Sequence[str],
    hot: skew.HotKeys | None,
    columns: list[str],
    *,
    alone: bool = False,
    passes: str | None = None,
) -> DataFrame:
    """Versions and markers from events in order: 0 ends one, 1 is a known version, 2 a staged change.

    The last event of an instant decides what holds from then on. An end that follows a
    version is that version's end; any other is a marker. ``alone``: no key has two events.
    Rows that the column ``passes`` marks stay as they are.
    """
    sequence = ["_at", "_kind", *[c for c in order if c in columns]]
    opens = (F.col("_kind") == 1) | ((F.col("_kind") == 2) & F.col(OPERATION).isin(*WRITTEN))
    opened = events.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    state = F.struct(F.col("_at").alias("at"), F.col("_opens").alias("opens"))
    if alone:
        empty = opened.select(F.col("_at").alias("_next"), state.alias("_last")).schema
        near = opened.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty})
    else:
        near = skew.neighbours(opened, key if passes is None else [*key, passes], sequence, state, hot)
    passing = F.lit(False) if passes is None else F.col(passes)
    ended = F.coalesce(F.col("_last.opens") & (F.col("_last.at") < F.col("_at")), F.lit(False))
    last = F.col("_next").isNull() | (F.col("_next") > F.col("_at"))
    standing = near.filter(passing | last).filter(passing | F.col("_opens") | ~ended)
    given = {c: F.col(c) for c in columns if c not in {*key, OPERATION, FROM, TO, CURRENT, INGESTED}}
    marked = {
        **{c: F.when(F.col("_opens"), v) for c, v in given.items()},
        OPERATION: F.when(F.col("_opens"), F.col(OPERATION)).otherwise("DELETE"),
        FROM: F.col("_at"),
        TO: F.when(F.col("_opens"), F.col("_next")).otherwise(F.col("_at")),
        CURRENT: F.col("_opens") & F.col("_next").isNull(),
    }
    if passes is not None:
        marked = {c: F.when(passing, F.col(c)).otherwise(v) for c, v in marked.items()}
    return standing.select(*[marked.get(c, F.col(c)).alias(c) for c in columns])


def _type_of(df: DataFrame, c: Column):
    return df.select(c.alias("_c")).schema["_c"].dataType
