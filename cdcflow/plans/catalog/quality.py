"""Rules, quarantine and transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cdcflow.operators import quarantine as Q, rules as R, transforms as X
from cdcflow.plans.catalog.base import Tables, dirty, event_changes, moment, query
from cdcflow.spec import Rule, Transform

SEQUENCE = (
    Rule("r_value", "range", "value", {"min": 5, "max": 200}),
    Rule("r_code", "allowed_values", "code", {"values": ["click", "view", "purchase"]}),
    Rule("r_unique", "unique", "value"),
    Rule("r_props", "length", "props", {"min": 9}),
)
WITH_WARNINGS = (
    Rule("w_high", "range", "value", {"max": 100}, severity="warning"),
    Rule("r_code", "not_null", "code"),
    Rule("w_ref", "regex", "ref", {"pattern": "^USR-"}, severity="warning"),
    Rule("r_props", "length", "props", {"max": 9}),
)

# Sequence in SQL: each step judges what the earlier ones let pass.
SEQUENCE_SQL = """
    s1 AS (SELECT *, CASE WHEN value IS NULL OR value < 5 OR value > 200 THEN 'r_value' END AS f1 FROM dirty),
    s2 AS (SELECT *, CASE WHEN f1 IS NULL AND (code IS NULL OR code NOT IN ('click', 'view', 'purchase'))
                          THEN 'r_code' END AS f2 FROM s1),
    dup AS (SELECT value FROM s2 WHERE f1 IS NULL AND f2 IS NULL GROUP BY value HAVING count(*) > 1),
    s3 AS (SELECT *, CASE WHEN f1 IS NULL AND f2 IS NULL AND value IN (SELECT value FROM dup)
                          THEN 'r_unique' END AS f3 FROM s2),
    judged AS (SELECT * EXCLUDE (f1, f2, f3),
                      coalesce(f1, f2, f3, CASE WHEN props IS NULL OR length(props) < 9 THEN 'r_props' END)
                      AS _failed_rule FROM s3)"""


def one_rule(t: Tables, rule: Rule) -> DataFrame:
    return R.tag_failures(dirty(t), [rule]).select("event_id", rule.column, R.FAILED)


def judged(t: Tables) -> DataFrame:
    return R.tag_failures(dirty(t), SEQUENCE)


@query(
    "dq_range",
    """SELECT event_id, value, CASE WHEN value BETWEEN 5 AND 150 THEN NULL ELSE 'r1' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_range(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "range", "value", {"min": 5, "max": 150}))


@query(
    "dq_allowed_values",
    """SELECT event_id, code, CASE WHEN code IN ('click', 'view') THEN NULL ELSE 'r1' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_allowed_values(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "allowed_values", "code", {"values": ["click", "view"]}))


@query(
    "dq_regex",
    r"""SELECT event_id, ref,
               CASE WHEN regexp_matches(ref, '-\d{5}[02468]') THEN NULL ELSE 'r1' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_regex(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "regex", "ref", {"pattern": r"-\d{5}[02468]"}))


@query(
    "dq_not_null",
    """SELECT event_id, code, CASE WHEN code IS NULL THEN 'r1' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_not_null(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "not_null", "code"))


@query(
    "dq_unique",
    """SELECT event_id, value, CASE WHEN count(*) OVER (PARTITION BY value) > 1 THEN 'r1' END AS _failed_rule
       FROM dirty""",
    ("dirty",),
)
def dq_unique(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "unique", "value"))


@query(
    "dq_length",
    """SELECT event_id, props, CASE WHEN length(props) BETWEEN 9 AND 20 THEN NULL ELSE 'r1' END AS _failed_rule
       FROM dirty""",
    ("dirty",),
)
def dq_length(t: Tables) -> DataFrame:
    return one_rule(t, Rule("r1", "length", "props", {"min": 9, "max": 20}))


@query("dq_rule_sequence", f"WITH {SEQUENCE_SQL} SELECT event_id, _failed_rule FROM judged", ("dirty",))
def dq_rule_sequence(t: Tables) -> DataFrame:
    return judged(t).select("event_id", R.FAILED)


@query(
    "dq_severity_warning",
    """
    SELECT event_id,
           CASE WHEN code IS NULL THEN 'r_code' WHEN props IS NULL OR length(props) > 9 THEN 'r_props' END
               AS _failed_rule,
           concat_ws(',', CASE WHEN value IS NULL OR value > 100 THEN 'w_high' END,
                          CASE WHEN code IS NOT NULL AND ref NOT LIKE 'USR-%' THEN 'w_ref' END) AS warned
    FROM dirty""",
    ("dirty",),
)
def dq_severity_warning(t: Tables) -> DataFrame:
    tagged = R.tag_failures(dirty(t), WITH_WARNINGS)
    return tagged.select("event_id", R.FAILED, F.array_join(R.WARNED, ",").alias("warned"))


@query(
    "dq_custom_rule",
    """SELECT event_id, ref, CASE WHEN starts_with(ref, 'USR') THEN NULL ELSE 'r1' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_custom_rule(t: Tables) -> DataFrame:
    if "prefix" not in R.list_rules():
        R.register_rule("prefix", lambda c, params: c.startswith(params["text"]))
    return one_rule(t, Rule("r1", "prefix", "ref", {"text": "USR"}))


@query(
    "dq_rule_summary",
    f"""
    WITH {SEQUENCE_SQL},
    n AS (SELECT count(*) AS a, count(*) FILTER (_failed_rule = 'r_value') AS f0,
                 count(*) FILTER (_failed_rule = 'r_code') AS f1, count(*) FILTER (_failed_rule = 'r_unique') AS f2,
                 count(*) FILTER (_failed_rule = 'r_props') AS f3 FROM judged)
    SELECT 'r_value' AS rule_id, 'error' AS severity, a AS evaluated, f0 AS failed, round((a - f0) / a, 6) AS pass_rate
    FROM n
    UNION ALL SELECT 'r_code', 'error', a - f0, f1, round((a - f0 - f1) / (a - f0), 6) FROM n
    UNION ALL SELECT 'r_unique', 'error', a - f0 - f1, f2, round((a - f0 - f1 - f2) / (a - f0 - f1), 6) FROM n
    UNION ALL SELECT 'r_props', 'error', a - f0 - f1 - f2, f3,
                     round((a - f0 - f1 - f2 - f3) / (a - f0 - f1 - f2), 6) FROM n""",
    ("dirty",),
)
def dq_rule_summary(t: Tables) -> DataFrame:
    return R.rule_summary(dirty(t), SEQUENCE).withColumn("pass_rate", F.round("pass_rate", 6))


UNNAMED_RULES = (
    Rule("unknown", "range", "value", {"min": 5}),
    Rule("unknown", "allowed_values", "event_type", {"values": ["click", "signup", "error"]}),
    Rule("unknown", "range", "value", {"max": 150}, severity="warning"),
    Rule("unknown", "range", "event_id", {"min": 100}, deletes=True),
)


@query(
    "dq_rule_summary_changes",
    """
    WITH c AS (SELECT *, _operation = 'DELETE' AS gone, value < 5 AND _operation <> 'DELETE' AS f0 FROM event_changes),
    d AS (SELECT *, NOT f0 AND NOT gone AND event_type NOT IN ('click', 'signup', 'error') AS f1 FROM c)
    SELECT 0 AS place, 'error' AS severity, count(*) FILTER (NOT gone) AS evaluated, count(*) FILTER (f0) AS failed FROM d
    UNION ALL SELECT 1, 'error', count(*) FILTER (NOT gone AND NOT f0), count(*) FILTER (f1) FROM d
    UNION ALL SELECT 2, 'warning', count(*) FILTER (NOT gone AND NOT f0 AND NOT f1),
                     count(*) FILTER (NOT gone AND NOT f0 AND NOT f1 AND value > 150) FROM d
    UNION ALL SELECT 3, 'error', count(*) FILTER (NOT f0 AND NOT f1),
                     count(*) FILTER (NOT f0 AND NOT f1 AND event_id < 100) FROM d""",
    ("event_changes",),
)
def dq_rule_summary_changes(t: Tables) -> DataFrame:
    """DELETE rows are judged only by the rule that asks for them; rules without a name stay apart."""
    found = R.rule_summary(event_changes(t), UNNAMED_RULES)
    place = F.when(F.col("severity") == "warning", 2)
    order = F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("evaluated"), F.desc("failed")))
    return found.withColumn("n", order).select(
        F.coalesce(place, F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), F.col("n"))).alias("place"),
        "severity", "evaluated", "failed",
    )


@query(
    "dq_allowed_null_pass",
    """
    SELECT event_id, code, value,
           CASE WHEN code IS NOT NULL AND code <> 'click' AND code <> 'view' THEN 'r_code'
                WHEN user_id % 2 = 1 AND user_id <> 1 AND user_id <> 3 THEN 'r_user' END AS _failed_rule
    FROM dirty""",
    ("dirty",),
)
def dq_allowed_null_pass(t: Tables) -> DataFrame:
    """NULL passes where it is let pass; a value outside the list does not."""
    odd = dirty(t).withColumn("odd", F.when(F.col("user_id") % 2 == 1, F.col("user_id")))
    rules = [
        Rule("r_code", "allowed_values", "code", {"values": ["click", "view"]}, on_null="pass"),
        Rule("r_user", "allowed_values", "odd", {"values": ["1", 3]}, on_null="pass"),
    ]
    return R.tag_failures(odd, rules).select("event_id", "code", "value", R.FAILED)


@query(
    "dq_lenient",
    """SELECT event_id, CASE WHEN code IS NULL THEN 'r_code' END AS _failed_rule FROM dirty""",
    ("dirty",),
)
def dq_lenient(t: Tables) -> DataFrame:
    """Rules that cannot be judged are left out, the usable one is not."""
    rules = [
        Rule("r_type", "no_such_type", "code"), Rule("r_column", "not_null", "no_such_column"), Rule("r_max", "range", "value", {"max": "abc"}),
        Rule("r_values", "allowed_values", "user_id", {"values": ["x"]}), Rule("r_code", "not_null", "code"),
    ]
    return R.tag_failures(dirty(t), rules, strict=False).select("event_id", R.FAILED)


@query(
    "dq_unique_several",
    """
    WITH a AS (SELECT *, count(*) OVER (PARTITION BY value) > 1 AS f1 FROM dirty),
    b AS (SELECT *, NOT f1 AND count(*) FILTER (NOT f1) OVER (PARTITION BY ref) > 1 AS f2 FROM a),
    c AS (SELECT *, NOT f1 AND NOT f2 AND count(*) FILTER (NOT f1 AND NOT f2) OVER (PARTITION BY user_id) > 1 AS f3 FROM b)
    SELECT event_id, CASE WHEN f1 THEN 'u_value' WHEN f2 THEN 'u_ref' WHEN f3 THEN 'u_user' END AS _failed_rule FROM c""",
    ("dirty",),
)
def dq_unique_several(t: Tables) -> DataFrame:
    rules = [Rule(f"u_{n}", "unique", c) for n, c in (("value", "value"), ("ref", "ref"), ("user", "user_id"))]
    return R.tag_failures(dirty(t), rules).select("event_id", R.FAILED)


def day() -> Column:
    return F.datediff("ts", F.lit("2024-01-01").cast("date"))


DAY_SQL = "date_diff('day', TIMESTAMP '2024-01-01', ts)"


def quarantined(t: Tables) -> DataFrame:
    """One batch per day; a row is set aside when its event happened."""
    return Q.quarantine_frame(judged(t), "events", day(), F.col("ts"))


@query(
    "quarantine_rows",
    f"""
    WITH {SEQUENCE_SQL}
    SELECT event_id, ts, user_id, code, value, ref, props, _failed_rule, ts AS _quarantined_at,
           strftime(ts, '%Y-%m-%dT%H:00:00') AS run_date, 'events' AS table_name, {DAY_SQL} AS batch_id
    FROM judged WHERE _failed_rule IS NOT NULL""",
    ("dirty",),
)
def quarantine_rows(t: Tables) -> DataFrame:
    return quarantined(t)


@query(
    "quarantine_by_hour",
    f"""
    WITH {SEQUENCE_SQL}
    SELECT strftime(ts, '%Y-%m-%dT%H:00:00') AS run_date, 'events' AS table_name, count(*) AS rows
    FROM judged WHERE _failed_rule IS NOT NULL GROUP BY 1""",
    ("dirty",),
)
def quarantine_by_hour(t: Tables) -> DataFrame:
    return Q.by_hour(quarantined(t))


@query(
    "quarantine_by_rule",
    f"""
    WITH {SEQUENCE_SQL}
    SELECT 'events' AS table_name, _failed_rule, strftime(ts, '%Y-%m-%dT%H:00:00') AS run_date, count(*) AS rows
    FROM judged WHERE _failed_rule IS NOT NULL GROUP BY 2, 3""",
    ("dirty",),
)
def quarantine_by_rule(t: Tables) -> DataFrame:
    return Q.by_rule(quarantined(t))


@query(
    "quarantine_summary",
    f"""
    WITH {SEQUENCE_SQL}
    SELECT 'events' AS table_name, {DAY_SQL} AS batch_id, count(*) AS total_rows,
           count(_failed_rule) AS quarantined_count, 0::BIGINT AS unknown_count,
           array_to_string(list_sort(list(DISTINCT _failed_rule) FILTER (_failed_rule IS NOT NULL)), ',')
               AS failed_rules,
           'quarantine' AS path, max(ts) AS quarantined_at
    FROM judged GROUP BY 2 HAVING count(_failed_rule) > 0""",
    ("dirty",),
)
def quarantine_summary(t: Tables) -> DataFrame:
    facts = Q.summary(judged(t), "events", day(), F.col("ts"), path="quarantine")
    return facts.withColumn("failed_rules", F.array_join("failed_rules", ","))


@query(
    "quarantine_union_tables",
    """
    SELECT event_id, code, NULL::BIGINT AS o_orderkey, NULL::DOUBLE AS o_totalprice, 'r_code' AS _failed_rule,
           'events' AS table_name, 7::BIGINT AS batch_id
    FROM dirty WHERE code IS NULL
    UNION ALL
    SELECT NULL, NULL, o_orderkey, o_totalprice, 'o_price', 'orders', 7 FROM orders
    WHERE o_totalprice NOT BETWEEN 5000 AND 450000""",
    ("dirty",),
)
def quarantine_union_tables(t: Tables) -> DataFrame:
    at = moment("2024-01-31")
    events = R.tag_failures(dirty(t).select("event_id", "code"), [Rule("r_code", "not_null", "code")])
    priced = R.tag_failures(
        t.orders.select("o_orderkey", "o_totalprice"),
        [Rule("o_price", "range", "o_totalprice", {"min": 5000, "max": 450000})],
    )
    both = Q.union_tables(Q.quarantine_frame(events, "events", 7, at), Q.quarantine_frame(priced, "orders", 7, at))
    return both.drop("_quarantined_at", "run_date")


# --- transforms -----------------------------------------------------------------------


def step(df: DataFrame, kind: str, column: str, **params) -> DataFrame:
    return X.apply_transforms(df, [Transform(kind, column, params)])


@query("tx_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS p_name FROM part")
def tx_trim(t: Tables) -> DataFrame:
    padded = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"))
    return step(padded, "trim", "p_name")


@query("tx_lower", "SELECT p_partkey, lower(p_brand) AS p_brand FROM part")
def tx_lower(t: Tables) -> DataFrame:
    return step(t.part.select("p_partkey", "p_brand"), "lower", "p_brand")


@query("tx_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def tx_upper(t: Tables) -> DataFrame:
    return step(t.part.select("p_partkey", "p_name"), "upper", "p_name")


@query(
    "tx_round",
    """SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18, 4)), 1) AS DOUBLE) AS c_acctbal FROM customer""",
)
def tx_round(t: Tables) -> DataFrame:
    return step(t.customer.select("c_custkey", "c_acctbal"), "round", "c_acctbal", decimals=1)


@query("tx_mask_pii", "SELECT c_custkey, substr(c_name, 1, 4) || '****' AS c_name FROM customer")
def tx_mask_pii(t: Tables) -> DataFrame:
    return step(t.customer.select("c_custkey", "c_name"), "mask_pii", "c_name")


@query("tx_mask_pii_last", "SELECT c_custkey, '****' || right(c_name, 3) AS c_name FROM customer")
def tx_mask_pii_last(t: Tables) -> DataFrame:
    return step(t.customer.select("c_custkey", "c_name"), "mask_pii", "c_name", visible_chars=3, keep="last")


@query(
    "tx_cast",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(trunc(value) AS INTEGER) END AS reading
       FROM events""",
)
def tx_cast(t: Tables) -> DataFrame:
    """Decimal text becomes whole numbers, other text NULL."""
    text = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return step(t.events.select("event_id", text.alias("reading")), "cast", "reading", target_type="integer")


@query(
    "tx_default_value",
    "SELECT event_id, coalesce(code, 'none') AS code, coalesce(value, -1) AS value FROM dirty",
    ("dirty",),
)
def tx_default_value(t: Tables) -> DataFrame:
    coded = step(dirty(t).select("event_id", "code", "value"), "default_value", "code", value="none")
    return step(coded, "default_value", "value", value=-1)


@query("tx_rename", "SELECT s_suppkey, s_name AS vendor FROM supplier")
def tx_rename(t: Tables) -> DataFrame:
    return step(t.supplier.select("s_suppkey", "s_name"), "rename", "s_name", new_name="vendor")


@query(
    "tx_sequence",
    """
    SELECT c_custkey, upper(substr(trim('  ' || c_name), 1, 10) || '****') AS label,
           CAST(trunc(c_acctbal) AS BIGINT) AS balance
    FROM customer""",
)
def tx_sequence(t: Tables) -> DataFrame:
    """Listed out of order on purpose: ``order`` decides, and later steps see the new name."""
    steps = [
        Transform("upper", "label", order=4),
        Transform("rename", "c_name", {"new_name": "label"}, order=3),
        Transform("mask_pii", "c_name", {"visible_chars": 10}, order=2),
        Transform("trim", "c_name", order=1),
        Transform("cast", "balance", {"to_type": "bigint"}),
    ]
    source = t.customer.select(
        "c_custkey", F.concat(F.lit("  "), "c_name").alias("c_name"), F.col("c_acctbal").alias("balance")
    )
    return X.apply_transforms(source, steps)


@query("tx_custom", "SELECT s_suppkey, reverse(s_name) AS s_name FROM supplier")
def tx_custom(t: Tables) -> DataFrame:
    if "backwards" not in X.list_transforms():
        X.register_transform("backwards", lambda df, column, params: df.withColumn(column, F.reverse(column)))
    return step(t.supplier.select("s_suppkey", "s_name"), "backwards", "s_name")


@query(
    "tx_cast_edges",
    """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN -12 WHEN 4 THEN 7
                                       WHEN 5 THEN 3 END::INTEGER AS n FROM events""",
)
def tx_cast_edges(t: Tables) -> DataFrame:
    """Texts without a whole part, with a fraction, blanks, a sign, no number and none at all."""
    texts = F.array(*[F.lit(x) for x in (".5", "-.5", "1.9", "-12.", " 7 ", "+3", "x", ".")])
    rows = t.events.select("event_id", F.element_at(texts, (F.col("event_id") % 8 + 1).cast("int")).alias("n"))
    return X.apply_transforms(rows, [Transform("cast", "n", {"target_type": "int"})])


@query("tx_lenient", "SELECT event_id, upper(event_type) AS event_type FROM events")
def tx_lenient(t: Tables) -> DataFrame:
    """Steps that cannot be applied are skipped, the others are not."""
    if "takes_missing" not in X.list_transforms():
        X.register_transform("takes_missing", lambda df, column, params: df.withColumn(column, F.col("no_such_column")))
    steps = [
        Transform("takes_missing", "event_type"), Transform("no_such_type", "event_type"), Transform("trim", "no_such_column"),
        Transform("cast", "event_id", {}), Transform("cast", "event_id", {"target_type": "blob"}), Transform("upper", "event_type"),
    ]
    return X.apply_transforms(t.events.select("event_id", "event_type"), steps, strict=False)
