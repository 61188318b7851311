"""Document fingerprints of closed syncmers over words, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cdcflow.session import written

#: Words of an anchor, and of the inner stretch whose place decides; anchors of characters have as many.
K, S = 5, 1
#: Texts of fewer words, or with more characters to a word on average, have anchors of characters as well.
SHORT, UNSPACED = 40, 40
#: Where the positions of anchors of characters begin.
CHARACTERS = 1 << 30
SPACE = r"[\x20\x09-\x0D]+"
LOW = 0xFFFFFFFF
#: Stands for null in joins on doc_id.
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def characters(text: Column, listed: Column) -> Column:
    """The characters of a short or unspaced text without its white space, none of any other; ``listed`` are its words."""
    few = (F.size(listed) < SHORT) | (F.char_length(text) > F.size(listed) * UNSPACED)
    joined = F.regexp_replace(text, SPACE, "")
    return F.when(few & (joined != ""), F.split(joined, "")).otherwise(F.array().cast("array<string>"))


def stretches(hashes: Column, inner: Column, k: int = K, s: int = S) -> Column:
    """Closed syncmers of word hashes as longs, position * 2 ** 32 + 32-bit hash, in text order.

    ``inner`` holds the hashes of every s neighbouring words. A stretch of k words is an anchor if the smallest of
    its inner hashes is the first or the last one (of equal ones the first): this depends on those k words alone, so
    an edit elsewhere changes no anchor. Comparisons stop at the first that fails, after three on average.
    """
    width = k - s + 1
    at = lambda i: F.get(inner, i)

    def edge(i: Column) -> Column:
        first, last = at(i) <= at(i + 1), at(i + width - 1) < at(i + width - 2)
        for step in range(2, width):
            first = first & (at(i) <= at(i + step))
            last = last & (at(i + width - 1) < at(i + width - 1 - step))
        return first | last

    place = lambda i: F.shiftleft(i.cast("long"), 32) + F.hash(F.slice(hashes, i + 1, F.lit(k))).cast("long").bitwiseAND(F.lit(LOW))
    places = F.sequence(F.lit(0), F.greatest(F.size(inner) - width, F.lit(0)))
    found = F.transform(F.filter(places, edge), place)
    return F.when(F.size(inner) >= width, found).otherwise(F.array().cast("array<long>"))


def with_stretches(df: DataFrame, listed: Column, name: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the syncmers of a list of words; each step is a column of its own, so none is worked out twice."""
    hashed = df.withColumn(f"{name}_h", F.transform(listed, lambda w: F.xxhash64(w)))
    inner = F.col(f"{name}_h")
    for i in range(1, s):
        later = F.slice(F.col(f"{name}_h"), i + 1, F.greatest(F.size(f"{name}_h"), F.lit(1)))
        inner = F.zip_with(inner, later, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    hashed = hashed.withColumn(f"{name}_g", F.slice(inner, 1, F.greatest(F.size(f"{name}_h") - (s - 1), F.lit(0))))
    return hashed.withColumn(name, stretches(F.col(f"{name}_h"), F.col(f"{name}_g"), k, s)).drop(f"{name}_h", f"{name}_g")


def with_characters(df: DataFrame, text: Column, listed: Column, name: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the syncmers of a text's characters where ``characters`` gives any, at positions from CHARACTERS on."""
    drawn = df.withColumn(f"{name}_c", characters(text, listed))
    found = with_stretches(drawn, F.col(f"{name}_c"), name, k, s)
    return found.withColumn(name, F.transform(name, lambda a: a + F.lit(CHARACTERS << 32))).drop(f"{name}_c")


def whole_hash(listed: Column) -> Column:
    """What stands for a text without any syncmer (fewer than k characters): the hash of its words, null without any."""
    return F.when(F.size(listed) > 0, F.hash(listed).cast("long").bitwiseAND(F.lit(LOW)))


def or_whole(found: Column, whole: Column) -> Column:
    return F.when((F.size(found) > 0) | whole.isNull(), found).otherwise(F.array(whole))


def with_anchors(df: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the anchors of a text column: syncmers of its words and, where it is short or unspaced, of its
    characters; or one at position 0 for the whole of a text without any."""
    listed = df.withColumn(f"{name}_w", words(F.col(text)))
    found = with_stretches(listed, F.col(f"{name}_w"), name, k, s)
    found = with_characters(found, F.col(text), F.col(f"{name}_w"), f"{name}_l", k, s)
    every = F.concat(name, f"{name}_l")
    return found.withColumn(name, or_whole(every, whole_hash(F.col(f"{name}_w")))).drop(f"{name}_w", f"{name}_l")


def printed(found: Column) -> Column:
    """position:hash of each anchor, comma-joined."""
    return F.array_join(
        F.transform(
            found,
            lambda a: F.concat(
                F.shiftrightunsigned(a, 32).cast("string"), F.lit(":"), F.lpad(F.lower(F.hex(a.bitwiseAND(F.lit(LOW)))), 8, "0")
            ),
        ),
        ",",
    )


def hashes(found: Column) -> Column:
    """The anchors' hashes alone, as 32-bit integers."""
    low = lambda a: a.bitwiseAND(F.lit(LOW))
    return F.transform(found, lambda a: F.when(low(a) > (LOW >> 1), low(a) - (LOW + 1)).otherwise(low(a)).cast("int"))


def likeness(left: Column, right: Column) -> Column:
    """Hashes that two texts share, over all of theirs, wherever they stand; two texts without any are alike."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def shared_places(left: Column, right: Column) -> Column:
    """(position in left, position in right) of each anchor of ``left`` whose hash ``right`` has, at its first place there."""
    value = lambda a: a.bitwiseAND(F.lit(LOW))
    there = F.transform(right, value)
    both = F.transform(
        left, lambda a: F.struct(F.shiftrightunsigned(a, 32).alias("left"), F.array_position(there, value(a)).alias("at"))
    )
    return F.transform(
        F.filter(both, lambda p: p["at"] > 0),
        lambda p: F.struct(p["left"].alias("left"), F.shiftrightunsigned(F.element_at(right, p["at"].cast("int")), 32).alias("right")),
    )


def next_rows(keys: DataFrame) -> DataFrame:
    """doc_id, mark, n_chars, next_id, next_mark: for each distinct row, the next one in descending (doc_id, mark).

    After the last comes the first. ``keys`` is sorted by range and written with the number of its part, so parts are
    fixed from then on; neighbours are found within parts, and the first row of each part, one for each, is what the
    last row of the part before it gets.
    """
    down = [F.desc("doc_id"), F.desc("mark")]
    parts = written(keys.distinct().sort(*down).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*down)
    row = F.struct("doc_id", "mark")
    inside = parts.withColumn("next", F.lead(row).over(within))
    # One row for each part of the sort.
    heads = parts.groupBy("part").agg(F.max(row).alias("first"))
    order = Window.orderBy("part")
    following = heads.select(
        F.col("part").alias("of"),
        F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"),
    )
    out = inside.join(following, F.col("part") == F.col("of")).withColumn("next", F.coalesce("next", "after"))
    return out.select("doc_id", "mark", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def edited_pairs(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, edited_sha256, anchors, edited_anchors, near_edited, near_next, next_id and next_chars of every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next row's, in descending doc_id; after the last comes the first. Null texts are empty. Rows that are
    equal in id and text stand in that order once and are returned as often as they come; equal ids with other texts
    are ordered by a hash of the text, null ids come last.

    Anchors depend on their own words alone, so those within the part that an edit keeps are the edited text's as well,
    and only its end is searched anew; short and unspaced texts have anchors of characters too, which are searched
    anew in the whole. The texts cross the network once, keyed by their row (both joins read that exchange), without
    their anchors, which take half a text's size: they are worked out where they are needed, for the row before and for
    the row itself. What a row sends to the one before it is the part of its text that replaces that one's end, and its
    anchors' hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    order = next_rows(rows.select("doc_id", "mark", "n_chars"))
    wants = order.select(
        F.col("doc_id").alias("to_id"), F.col("mark").alias("to_mark"), "next_id", "next_mark",
        F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"),
    )
    followers = rows.join(wants, (rows.doc_id == wants.next_id) & (rows.mark == wants.next_mark))
    found = with_anchors(followers, "text", "anchors", k, s).select(
        "to_id", "to_mark", F.substring("text", F.lit(1), F.col("wanted")).alias("tail"), hashes(F.col("anchors")).alias("next_hashes"),
        F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"),
    )
    # A row that comes several times is sent once; all its copies are equal.
    copies = Window.partitionBy("to_id", "to_mark").orderBy("next_id")
    sent = found.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")
    own = rows.join(sent, (rows.doc_id == sent.to_id) & (rows.mark == sent.to_mark)).drop("mark")
    listed = with_stretches(own.withColumn("words", words(F.col("text"))), F.col("words"), "syncmers", k, s)
    listed = with_characters(listed, F.col("text"), F.col("words"), "letters", k, s)
    joined = listed.withColumn("whole", whole_hash(F.col("words"))).drop("words")
    anchors = or_whole(F.concat("syncmers", "letters"), F.col("whole"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    cut = joined.withColumn("kept", F.substring("text", F.lit(1), keep)).withColumn("pieces", F.split("kept", SPACE))
    # The last piece may be part of a word, or empty; all words before it stay as they are.
    safe = F.array_remove(F.slice("pieces", 1, F.size("pieces") - 1), "")
    ends = cut.withColumn("safe", safe).withColumn("rest", words(F.concat(F.element_at("pieces", -1), F.col("tail"))))
    from_ = F.greatest(F.size("safe") - (k - 1), F.lit(0))
    near = ends.withColumn("from", from_).withColumn("end", F.concat(F.slice("safe", F.col("from") + 1, F.lit(k)), F.col("rest")))
    searched = with_stretches(near, F.col("end"), "end_anchors", k, s)
    stays = F.filter("syncmers", lambda a: F.shiftrightunsigned(a, 32) + k <= F.size("safe"))
    moved = F.transform("end_anchors", lambda a: a + F.shiftleft(F.col("from").cast("long"), 32))
    searched = searched.withColumn("edited_words", F.concat("safe", "rest"))
    searched = with_characters(searched, F.concat("kept", "tail"), F.col("edited_words"), "edited_letters", k, s)
    every = F.concat(stays, moved, F.col("edited_letters"))
    both = searched.withColumn("edited_anchors", or_whole(every, whole_hash(F.col("edited_words"))))
    both = both.withColumn("anchors", anchors)
    return both.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        F.sha2(F.concat("kept", "tail").cast("binary"), 256).alias("edited_sha256"),
        "anchors",
        "edited_anchors",
        likeness(hashes(F.col("anchors")), hashes(F.col("edited_anchors"))).alias("near_edited"),
        likeness(hashes(F.col("anchors")), F.col("next_hashes")).alias("near_next"),
        F.nullif("next_id", F.lit(NO_ID)).alias("next_id"),
        "next_chars",
    )
