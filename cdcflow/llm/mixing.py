"""Sources mixed to target weights over training time, in DataFrame functions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cdcflow.llm.common import WORD, bucket_bits, fresh, running_before

#: Weights of the sources in code point order, repeating; and for each the relative weight at points of training
#: time, linear between them. A schedule decides when a source's words come, its weight how many.
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def words(column: Column | str) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def digest(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The place of a row within its source: an md5 of its doc_id and that of its text; nulls count as empty."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(whole(doc_id), F.lit(":"), F.md5(whole(text).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """rank, source, source_size and target for each source of ``sizes`` (source, size).

    Targets share the sum of all sizes by weight; those above ``most`` times their source's size stop there and the
    excess goes to the others by weight until none is above. That is one level L with target = min(weight * L,
    most * size): the stopped sources are those with the smallest most * size / weight, found by running sums over
    the table of sources, which is the only one ever ordered as a whole.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(named) - 1)
    given = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", given).withColumn("limit", F.col("source_size") * most)
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "rank")
    earlier, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = lambda limits, shares: (F.sum("source_size").over(every) - limits).cast("double") / (
        F.sum("weight").over(every) - shares
    ).cast("double")
    zero = F.lit(0).cast("long")
    before = ranked.withColumn(
        "open", level(F.coalesce(F.sum("limit").over(earlier), zero), F.coalesce(F.sum("weight").over(earlier), zero))
    )
    stopped = before.withColumn("stops", F.col("limit").cast("double") < F.col("open") * F.col("weight"))
    stopped_sum = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(zero)).over(every)
    left = F.sum("weight").over(every) - stopped_sum("weight")
    final = (F.sum("source_size").over(every) - stopped_sum("limit")).cast("double") / F.nullif(left, zero).cast("double")
    return stopped.withColumn("level", final).select(
        "rank",
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def position(share: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time, 0 to 1, at which the share of a source's words is used up: its integrated schedule inverted.

    The integral of a piecewise linear schedule is piecewise quadratic. The pieces are constants; the one that holds
    the wanted amount is picked and its quadratic solved in the form that also holds for flat and zero pieces.
    """
    pieces = []
    for knots in schedules:
        done, found = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            found.append((t0, w0, (w1 - w0) / (t1 - t0), done))
            done += (t1 - t0) * (w0 + w1) / 2
        pieces.append((found, done))
    row = lambda p: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(p, ("at", "weight", "slope", "done"), strict=True)))
    table = F.array(*(F.struct(F.array(*map(row, f)).alias("pieces"), F.lit(d).alias("all")) for f, d in pieces))
    own = F.element_at(table, (rank % len(schedules) + 1).cast("int"))
    amount = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * own["all"]
    piece = F.element_at(F.filter(own["pieces"], lambda p: p["done"] <= amount), -1)
    rest = amount - piece["done"]
    under = piece["weight"] + F.sqrt(F.greatest(piece["weight"] ** 2 + 2 * piece["slope"] * rest, F.lit(0.0)))
    return piece["at"] + F.when(under > 0, 2 * rest / under).otherwise(0.0)


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, schedules: tuple = SCHEDULES, size: str | None = None,
    order: str | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its place in the mix, and the names of the added columns.

    Added: size (words), source_size, target, taken (words taken, repeats counted), uses (array of epoch, words and
    position for each epoch that takes any) and position (of the first use, null if not taken). The rows of a source
    stand in the order of ``digest`` (or of the columns ``order`` and ``size`` that hold what it and ``words`` give), ``most`` times over, and the words up to the rounded target are
    taken: whole texts but for the one at the border, so a source's taken words are its target to the nearest word
    and no row gives more than ``most`` times its size. Order within a source comes from running sums over hash
    buckets, so neither a hot source nor a hot doc_id, null too, is one task. Rows with equal doc_id are told apart by
    their text; equal rows may change places. Null sources are a source, the last one; null and empty texts have size 0 and are never taken.
    """
    names = dict(
        zip(
            ("size", "source_size", "target", "taken", "uses", "position"),
            fresh(docs, "size", "source_size", "target", "taken", "uses", "position"),
            strict=True,
        )
    )
    key, rank, before, upper, source, join_rank = fresh(docs, "_key", "_rank", "_before", "_upper", "_source", "_join_rank")
    own = names["size"]
    sized = docs.withColumn(own, F.col(size) if size else words("text"))
    sized = sized.withColumn(upper, F.col(order) if order else digest())
    sized = sized.withColumn(key, F.shiftleft(F.conv(F.substring(upper, 1, 15), 16, 10).cast("long"), 4))
    table = targets(sized.select(F.col("source").alias("source"), F.col(own).alias("size")), weights, most).select(
        F.col("source").alias(source), F.col("rank").alias(rank), F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
    )
    bits = bucket_bits(sized.count())
    ordered = running_before(sized, ["source"], key, [upper, "doc_id", own], own, before, bits)
    placed = ordered.join(table, F.col("source").eqNullSafe(F.col(source)))
    goal = F.floor(F.col(names["target"]) + 0.5).cast("long")
    whole = F.col(names["source_size"])
    use = lambda e: F.struct(
        e.alias("epoch"),
        F.greatest(F.lit(0), F.least(F.col(own), goal - e * whole - F.col(before))).cast("long").alias("words"),
        position((e * whole + F.col(before)).cast("double") / F.nullif(goal, F.lit(0)), F.col(rank), schedules).alias("position"),
    )
    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), use), lambda u: u["words"] > 0)
    taken = F.aggregate(F.col(names["uses"]), F.lit(0).cast("long"), lambda s, u: s + u["words"])
    out = placed.withColumn(names["uses"], uses).withColumn(names["taken"], taken).withColumn(
        names["position"], F.try_element_at(F.col(names["uses"]), F.lit(1))["position"]
    )
    return out.drop(key, rank, before, upper, source), names


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The words of the mix as rows of the columns of ``docs``, range-sorted by training position.

    A document comes once for each use; where the mix takes only its first words, the text is cut to them, joined
    by spaces. An ``n_chars`` column follows the cut text.
    """
    out, names = mixed(docs, **options)
    (use,) = fresh(out, "_use")
    rows = out.withColumn(use, F.explode(names["uses"]))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(f"{use}.words").cast("int")), " ")
    cut = F.col(f"{use}.words") < F.col(names["size"])
    text = F.when(cut, part).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.sort(F.col(f"{use}.position"), "doc_id", F.col(f"{use}.epoch")).select(*docs.columns)
