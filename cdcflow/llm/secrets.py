"""Secrets in texts: fixed patterns, and a randomness test battery with false-discovery control; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cdcflow.llm.common import fresh
from cdcflow.session import written

# The patterns of the three known kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: A run of these characters, at least so long, is a candidate of the battery; '=' is part of it only as padding.
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_-]", 20
PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Parts of a candidate that are candidates too: what common prefixes, paths and separators leave of an alphabet.
PARTS = (r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]", r"[A-Za-z0-9]")
#: Alphabets by name, in the order in which they are tried; the first that holds all of a candidate is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Six letters that often follow each letter in English words and names, set by hand.
FOLLOWERS = {
    "a": "ntlrsc", "b": "elouar", "c": "oheatk", "d": "eiaosu", "e": "rnsdat", "f": "oireat", "g": "ehraio",
    "h": "eaiotr", "i": "ntsoce", "j": "uoeais", "k": "eisnay", "l": "eiyalo", "m": "eaoipm", "n": "tgdeso",
    "o": "nrufmt", "p": "eroalt", "q": "uaiest", "r": "eioast", "s": "teihsu", "t": "hieoar", "u": "rsntlp",
    "v": "eiaoyu", "w": "iaheon", "x": "ptaice", "y": "osetmp", "z": "eaiozy",
}
BIGRAMS = "|".join(a + b for a, after in FOLLOWERS.items() for b in after)
#: Share of a structured text's letters that are among the followers of the letter before.
FOLLOWING = 0.75
#: Chances that a lower-case letter, capital, digit or sign of a structured text is followed by each of these.
SWITCHES = ((0.84, 0.07, 0.05, 0.04), (0.40, 0.50, 0.06, 0.04), (0.08, 0.08, 0.80, 0.04), (0.50, 0.25, 0.20, 0.05))
#: A candidate that the battery finds this unlikely to be random is none; share of false finds that is accepted.
REJECT, DISCOVERY = 1e-3, 0.05
#: p values are told apart in steps of a factor of 2 ** (1 / 4) for the false-discovery threshold.
STEPS = 4
#: z values of structured candidates count up to this; so many candidates with the given square stand for a class before any is seen.
FARTHEST, PRIOR, PRIOR_SQUARE = 4.0, 16, 4.0
TESTS = ("chi", "runs", "serial")
#: Running sums over arrays and cuts of texts go by blocks of so many elements or characters.
BLOCK, CUT = 256, 4096


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and not wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, add) -> Column:
    """For each of ``values`` what ``add``, an associative one, makes of the earlier ones; ``zero`` for the first.

    A fold that appends copies its list at each step, so lists are kept to a block; then blocks get their start.
    """

    def fold(items: Column, value) -> Column:
        start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("list"))
        step = lambda s, v: F.struct(add(s["at"], value(v)).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list"))
        return F.aggregate(items, start, step)

    def joined(folded: Column) -> Column:
        starts = fold(folded, lambda block: block["at"])["list"]
        both = F.arrays_zip(folded.alias("block"), starts.alias("start"))
        return F.flatten(F.transform(both, lambda b: F.transform(b["block"]["list"], lambda v: add(b["start"], v))))

    def blocked(items: Column) -> Column:
        last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), lambda v: v))

    return let(let(values, blocked), joined)


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, to 8e-8 (a rational approximation of the tail)."""
    return F.element_at(F.transform(F.array(z), _normal_below), 1)


def _normal_below(z: Column) -> Column:
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # The coefficients of the approximation, ascending powers of t.
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, tail).otherwise(1 - tail)


def spans(text: Column, pattern: str, kind: str, wanted, prefilter: Column) -> Column:
    """(start, kind, end, found) of the matches of ``pattern`` that ``wanted`` accepts; code points, end exclusive.

    What lies between the matches comes from a split by the same pattern, so that the positions are running sums of
    lengths: one pass over the text, and time in proportion to the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    one = F.struct(F.lit(0).alias("start"), F.lit("").alias("kind"), F.lit(0).alias("end"), F.lit("").alias("found"))
    empty = F.filter(F.array(one), lambda _: F.lit(False))
    both = lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("found"))
    measured = F.transform(
        let(found, both),
        lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["found"]).alias("length"), m["found"].alias("found")),
    )

    def placed(matches: Column) -> Column:
        before = running(F.transform(matches, lambda m: m["gap"] + m["length"]), F.lit(0), lambda x, y: x + y)
        at = lambda x: x["before"] + x["match"]["gap"]
        made = F.transform(
            F.arrays_zip(matches.alias("match"), before.alias("before")),
            lambda x: F.struct(
                at(x).alias("start"), F.lit(kind).alias("kind"), (at(x) + x["match"]["length"]).alias("end"), x["match"]["found"].alias("found")
            ),
        )
        return F.filter(made, lambda m: wanted(m["found"]))

    return F.when(prefilter, let(measured, placed)).otherwise(empty)


def with_parts(candidate: Column) -> Column:
    """A candidate and those of its parts that are long enough, each once, by start."""
    found = candidate["found"]
    one = F.transform(F.array(candidate), lambda c: c)
    mixed = found.rlike("[+/_-]")
    parts = F.concat(*(spans(found, f"{p}{{{SHORTEST},}}(?:=+$)?", "random", lambda _: F.lit(True), mixed) for p in PARTS))
    moved = F.transform(
        parts,
        lambda p: F.struct((p["start"] + candidate["start"]).alias("start"), p["kind"].alias("kind"), (p["end"] + candidate["start"]).alias("end"), p["found"].alias("found")),
    )
    return let(F.array_sort(F.concat(one, moved)), unlike_the_last)


def unlike_the_last(found: Column) -> Column:
    """A sorted array of spans without those that equal the one before."""
    return F.filter(found, lambda s, i: (i == 0) | (F.try_element_at(found, i) != s))


def outermost(found: Column) -> Column:
    """The spans that lie in no other one, each once: those that reach beyond all that begin before them."""
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s.alias("s")))

    def reaching(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda k: k["s"]["end"]), F.lit(-1), F.greatest)
        both = F.arrays_zip(ordered.alias("k"), reach.alias("reach"))
        return F.transform(F.filter(both, lambda x: x["k"]["s"]["end"] > x["reach"]), lambda x: x["k"]["s"])

    return let(F.array_sort(keyed), reaching)


def apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap none of ``base``, by start; candidates do not overlap each other.

    In the order of starts a candidate overlaps an earlier span that reaches into it or a later one that begins in it.
    """
    other = F.transform(base, lambda s: F.struct(s["start"].alias("a"), F.lit(0).alias("b"), s["end"].alias("end"), s.alias("s")))
    own = F.transform(candidates, lambda s: F.struct(s["start"].alias("a"), F.lit(1).alias("b"), s["end"].alias("end"), s.alias("s")))

    def free(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda k: F.when(k["b"] == 0, k["end"]).otherwise(-1)), F.lit(-1), F.greatest)
        far = F.lit((1 << 31) - 1)
        starts = F.reverse(F.transform(ordered, lambda k: F.when(k["b"] == 0, k["a"]).otherwise(far)))
        ahead = F.reverse(running(starts, far, F.least))
        rows = F.arrays_zip(ordered.alias("k"), reach.alias("reach"), ahead.alias("ahead"))
        clear = lambda x: (x["k"]["b"] == 1) & (x["reach"] <= x["k"]["a"]) & (x["ahead"] >= x["k"]["end"])
        return F.transform(F.filter(rows, clear), lambda x: x["k"]["s"])

    alone = (F.size(base) == 0) | (F.size(candidates) == 0)
    return F.when(alone, candidates).otherwise(let(F.array_sort(F.concat(other, own)), free))


def known(text: Column) -> Column:
    """Spans of the known kinds, by start and then kind as listed."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(lower, F.lit(word))
    value = lambda found: F.char_length(F.regexp_extract(found, PATTERNS["assign"], 2)) >= LEAST["assign"]
    long = lambda kind: lambda found: F.char_length(found) >= LEAST[kind]
    # Runs are maximal, so shorter ones need not be matched at all.
    runs = r"[0-9a-f]{%d,}" % LEAST["hex"]
    parts = [
        spans(text, PATTERNS["assign"], "assign", value, named),
        spans(text, PATTERNS["access"], "access", long("access"), F.contains(text, F.lit("AKIA"))),
        spans(text, runs, "hex", long("hex"), text.rlike(runs)),
    ]
    return by_start(F.concat(*parts))


def by_start(found: Column) -> Column:
    place = {k: i for i, k in enumerate((*KINDS, "random"))}
    rank = lambda s: F.element_at(F.create_map(*(F.lit(x) for kv in place.items() for x in kv)), s["kind"])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _class(c: Column) -> Column:
    """0 to 3: lower-case letter, capital, digit, sign."""
    return F.when((c >= "a") & (c <= "z"), 0).when((c >= "A") & (c <= "Z"), 1).when((c >= "0") & (c <= "9"), 2).otherwise(3)


def told(chars: Column) -> Column:
    """Log likelihood of a list of characters as structured text: names, words, numbers and what joins them.

    A chain: the class of a character follows that of the one before (SWITCHES; the first follows a sign), a letter
    after a letter is one of its followers with the chance FOLLOWING, all else within a class is even.
    """
    before = F.concat(F.array(F.lit("/")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))
    pairs = F.arrays_zip(before.alias("x"), chars.alias("y"))
    switch = F.array(*(F.lit(math.log(p)) for row in SWITCHES for p in row))
    hit, miss, even = (F.lit(math.log(p)) for p in (FOLLOWING / 6 + (1 - FOLLOWING) / 26, (1 - FOLLOWING) / 26, 1 / 26))

    def one(p: Column) -> Column:
        x, y = _class(p["x"]), _class(p["y"])
        follows = F.contains(F.lit(BIGRAMS), F.lower(F.concat(p["x"], p["y"])))
        letter = F.when(x > 1, even).when(follows, hit).otherwise(miss)
        return F.element_at(switch, 4 * x + y + 1) + F.when(y == 2, F.lit(-math.log(10))).when(y == 3, F.lit(-math.log(4))).otherwise(letter)

    return F.aggregate(pairs, F.lit(0.0), lambda total, p: total + one(p))


def battery(token: Column) -> Column:
    """(encoding, n, random, chi, runs, serial, ratio): three tests for randomness and a likelihood ratio.

    The encoding is the first alphabet that holds every character (padding ``=`` aside); a candidate needs digits
    and letters, or both cases, to have one. With a characters in the alphabet and n in the string:
    chi-squared distance of its character counts from even ones (mean a - 1, variance 2 (a - 1)(n - 1) / n),
    the number of runs above and below the alphabet's middle, and the lag-1 serial correlation of places in the
    alphabet give three z values, each about standard normal for random strings; ``random`` is three times the
    smallest tail, at most 1. ``ratio`` is the log likelihood of even characters less that of structured text
    (``told``): letter pairs, changes between cases, digits and signs all count, so 20 characters tell much.
    """
    body = F.regexp_replace(token, "=+$", "")
    letters = F.lit(None).cast("string")
    for alphabet in reversed(ALPHABETS.values()):
        letters = F.when(body.rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), F.lit(alphabet)).otherwise(letters)
    kinds = sum((body.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    known_as = F.struct(F.when(kinds >= 2, letters).alias("letters"), F.filter(F.split(body, ""), lambda c: c != "").alias("chars"))

    def located(x: Column) -> Column:
        places = F.transform(x["chars"], lambda c: F.position(c, x["letters"]).cast("double"))
        counts = F.transform(F.array_distinct(x["chars"]), lambda c: F.size(F.filter(x["chars"], lambda d: d == c)).cast("double"))
        return F.struct(
            told(x["chars"]).alias("told"), x["letters"].alias("letters"), F.char_length(x["letters"]).cast("double").alias("a"), F.size(x["chars"]).cast("double").alias("n"),
            places.alias("places"), F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c).alias("squares"),
            (F.aggregate(places, F.lit(0.0), lambda s, p: s + p) / F.size(places)).alias("mean"),
        )

    def summed(x: Column) -> Column:
        pairs = F.arrays_zip(F.slice(x["places"], 1, F.size(x["places"]) - 1).alias("x"), F.slice(x["places"], 2, F.size(x["places"]) - 1).alias("y"))
        total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, p: s + f(p))
        high = lambda p: p > x["a"] / 2
        return F.struct(
            x["told"].alias("told"), x["letters"].alias("letters"), x["a"].alias("a"), x["n"].alias("n"), (x["squares"] * x["a"] / x["n"] - x["n"]).alias("chi"),
            total(x["places"], lambda p: high(p).cast("double")).alias("above"),
            (1 + total(pairs, lambda p: (high(p["x"]) != high(p["y"])).cast("double"))).alias("runs"),
            total(x["places"], lambda p: (p - x["mean"]) * (p - x["mean"])).alias("variance"),
            total(pairs, lambda p: (p["x"] - x["mean"]) * (p["y"] - x["mean"])).alias("joint"),
        )

    def judged(x: Column) -> Column:
        n, a = x["n"], x["a"]
        z_chi = (x["chi"] - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        expected = 1 + 2 * x["above"] * (n - x["above"]) / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (x["runs"] - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
        z_serial = F.when(x["variance"] > 0, x["joint"] / x["variance"] * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.lit(9.0))
        tails = [2 * normal_below(-F.abs(z)) for z in (z_runs, z_serial)]
        return F.struct(
            x["letters"].alias("encoding"), n.cast("int").alias("n"),
            F.least(F.lit(1.0), 3 * F.least(normal_below(-z_chi), *tails)).alias("random"),
            z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), (-x["told"] - n * F.log(a)).alias("ratio"),
        )

    # Each step is a list of one, so that it is worked out once and not wherever it is used.
    steps = F.array(known_as)
    for step in (located, summed, judged):
        steps = F.transform(steps, step)
    return F.element_at(steps, 1)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base and tested spans of every row: one pass over the texts, written to the shared folder.

    ``base`` holds the known kinds; ``tested`` the candidates outside them, and their parts, that have an encoding
    and that the battery does not reject as random, with what it says of them and their length class.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = f"{CANDIDATE}{{{SHORTEST},}}{PADDING}"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", known(F.col("text")).alias("base"),
        spans(F.col("text"), runs, "random", lambda _: F.lit(True), F.col("text").rlike(runs)).alias("candidates"),
    )
    parted = F.flatten(F.transform(apart(F.col("candidates"), F.col("base")), with_parts))
    tested = F.transform(parted, lambda c: F.struct(c.alias("span"), battery(c["found"]).alias("b")))
    kept = F.filter(tested, lambda t: t["b"]["encoding"].isNotNull() & (t["b"]["random"] > REJECT))
    shaped = F.transform(
        kept,
        lambda t: F.struct(
            t["span"].alias("span"), F.floor(F.log2(t["b"]["n"])).cast("int").alias("length_class"),
            *(t["b"][x].alias(x) for x in (*TESTS, "ratio")),
        ),
    )
    return written(base.select("doc_id", "base", shaped.alias("tested")))


def spreads(found: DataFrame) -> dict[int, tuple[float, ...]]:
    """How far each test's z values stray, by length class, among the candidates that read as structured text.

    Their ratio speaks for structure. Far values count as FARTHEST, and PRIOR candidates are thought to be in every
    class, so a spread lies between 1, where a test tells nothing, and FARTHEST. Sums are of integers, so they
    do not depend on the order of rows. At most 31 classes exist.
    """
    each = found.select(F.explode("tested").alias("t")).where(F.col("t.ratio") <= 0)
    square = lambda x: F.round(F.least(F.col(f"t.{x}") * F.col(f"t.{x}"), F.lit(FARTHEST**2)) * 1000).cast("long")
    rows = each.groupBy("t.length_class").agg(F.count("*").alias("n"), *(F.sum(square(x)).alias(x) for x in TESTS)).collect()
    mean = lambda total, n: (PRIOR * PRIOR_SQUARE + total / 1000) / (PRIOR + n)
    return {r["length_class"]: tuple(max(1.0, math.sqrt(mean(r[x], r["n"]))) for x in TESTS) for r in rows}


def stepped(found: DataFrame, spread: dict[int, tuple[float, ...]]) -> DataFrame:
    """``found`` with ``evidence`` and ``step`` in each tested span: how unlikely a structured string is to be like this.

    Under chance a test's z is standard normal, under structure it has the spread of its class; the log ratio of
    the two densities, for each of the three tests, is added to the ratio of the characters. If structure is right,
    the combined ratio is at least 1 / p with a chance of at most p (Markov), so p = exp(-evidence), at most 1.
    """
    usual = (math.sqrt(PRIOR_SQUARE),) * len(TESTS)
    by_class = F.array(*(F.array(*map(F.lit, spread.get(c, usual))) for c in range(32)))

    def evidence(t: Column) -> Column:
        own = F.element_at(by_class, t["length_class"] + 1)
        tests = [(t[x], F.element_at(own, i + 1)) for i, x in enumerate(TESTS)]
        return sum((F.log(s) - z * z / 2 * (1 - 1 / (s * s)) for z, s in tests), t["ratio"])

    weighed = F.transform("tested", lambda t: F.struct(t["span"].alias("span"), t["length_class"].alias("length_class"), evidence(t).alias("evidence")))
    p = lambda t: F.least(F.lit(0.0), -t["evidence"] / math.log(2))
    lowest = F.lit(-1000.0)
    return found.withColumn(
        "tested", F.transform(weighed, lambda t: F.struct(
            *(t[x].alias(x) for x in ("span", "length_class", "evidence")), F.floor(F.greatest(p(t), lowest) * STEPS).cast("int").alias("step"),
        )),
    )


def thresholds(found: DataFrame) -> DataFrame:
    """length_class and limit: the largest step whose finds keep the false-discovery rate (Benjamini, Hochberg).

    Every class of lengths (a power of two) is controlled on its own, so that many short candidates cannot lend
    significance to each other's place. p values count as the upper end of their step. Counts by class and step, some
    hundred thousand rows at most, are all it needs.
    """
    each = found.select(F.explode("tested").alias("t")).groupBy("t.length_class", "t.step").count()
    order = Window.partitionBy("length_class").orderBy("step")
    ranked = each.withColumn("rank", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy("length_class")))
    upper = F.pow(F.lit(2.0), (F.col("step") + 1) / STEPS)
    return ranked.where(upper <= DISCOVERY * F.col("rank") / F.col("all")).groupBy("length_class").agg(F.max("step").alias("limit"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, found) of every row of ``docs``.

    ``base`` are the known kinds: leftmost non-overlapping matches of each pattern that are long enough. ``spans``
    are these and the candidates of the battery that pass its false-discovery control, kind ``random``, by start and
    then kind; parts of a candidate that passes are left to it. Null texts are empty; rows without doc_id and repeated rows are scanned like others.
    """
    raw = scanned(docs)
    found = stepped(raw, spreads(raw))
    # At most 31 length classes exist.
    limits = {r["length_class"]: r["limit"] for r in thresholds(found).collect()}
    below = lambda t: t["step"] <= F.element_at(F.array(*(F.lit(limits.get(c, -(1 << 30))) for c in range(32))), t["length_class"] + 1)
    passed = F.filter("tested", below)
    return found.select(
        "doc_id", "base", by_start(F.concat("base", outermost(F.transform(passed, lambda t: t["span"])))).alias("spans")
    )


def covered(text: Column, found: Column, mark: str) -> Column:
    """``text`` with ``mark`` in the place of each group of overlapping spans of ``found``, which are in order of start.

    The text is cut into blocks in one pass; what stays between two spans is read from the blocks it lies in.
    """

    def with_blocks(blocks: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / CUT).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(near, start - first * CUT + 1, end - start)).otherwise("")

        def parts(reach: Column) -> Column:
            rows = F.arrays_zip(found.alias("span"), reach.alias("reach"))
            apart = F.filter(rows, lambda x: (x["span"]["start"] >= x["reach"]) | (x["reach"] == 0))
            kept = F.transform(apart, lambda x: F.concat(between(x["reach"], x["span"]["start"]), F.lit(mark)))
            rest = between(F.array_max(F.transform(found, lambda s: s["end"])), F.char_length(text))
            return F.array_join(F.concat(kept, F.array(rest)), "")

        return let(running(F.transform(found, lambda s: s["end"]), F.lit(0), F.greatest), parts)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0)), with_blocks)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in the place of every secret; overlapping ones become one mark.

    Each column stays, ``n_chars`` follows the text. Texts without secrets, null ones included, are left as they are.
    Two passes: the battery's thresholds need the spans of all texts first.
    """
    spans_of, key, other = fresh(docs, "_spans", "_key", "_other_key")
    hashed = F.xxhash64("doc_id", "text")
    found = secrets(docs.select(hashed.alias("doc_id"), "text")).where(F.size("spans") > 0)
    marked = found.groupBy(F.col("doc_id").alias(other)).agg(F.first("spans").alias(spans_of))
    joined = docs.withColumn(key, hashed).join(marked, F.col(key) == F.col(other), "left")
    text = F.col("text")

    clean = F.when(F.col(spans_of).isNull(), text).otherwise(covered(text, F.col(spans_of), mark))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col(spans_of).isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", length.cast(kind))
    return out.select(*docs.columns)
