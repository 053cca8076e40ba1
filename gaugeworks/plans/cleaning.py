"""Order, sets, cleaning and validation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.portable import portable_hash_sql
from gaugeworks.operators import eventlog as ev
from gaugeworks.operators import filters as f
from gaugeworks.operators import quality as q
from gaugeworks.operators import sets as s
from gaugeworks.operators import space
from gaugeworks.operators.joins import row_hash
from gaugeworks.operators.project import clip
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.learning import READINGS, readings, standard_sql
from gaugeworks.plans.registry import query
from gaugeworks.plans.windows import HOLES_SQL, holes
from gaugeworks.session import spread


@query("srt_01_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def page(t):
    return s.page(t.orders, "o_totalprice", "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@query("srt_02_top_events", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_events(t):
    return s.top_groups(t.events, ["user_id"], 10)


@query("srt_03_slowest", "SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 240 HOUR ORDER BY value DESC, event_id LIMIT 10")
def slowest(t):
    return s.slowest(t.events, "value", "ts", "event_id", "2024-01-20", 240, 10).select("event_id", "value")


@query("srt_04_ranked_share", "WITH g AS (SELECT p_brand, sum(p_size)::BIGINT AS score FROM part GROUP BY 1) SELECT p_brand, score, round(score / sum(score) OVER (), 9) AS share FROM g")
def ranked(t):
    return rounded(s.ranked_share(t.part.groupBy("p_brand").agg(F.sum("p_size").alias("score")), "score", "p_brand"), 9)


@query("srt_04_best", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1")
def best(t):
    return s.best(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@query("srt_05_recent_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC LIMIT 50")
def recent(t):
    return s.recent(t.events, "ts", 50).select("event_id", "event_type")


@query("set_01_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount + 0.0 AS l_discount FROM lineitem")
def distinct(t):
    return s.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_discount") + 0.0).alias("l_discount")))


@query("set_02_missing_rows", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def missing(t):
    assert s.missing_columns(t.orders, ["o_orderkey", "o_absent"]) == ["o_absent"]
    return s.missing_rows(t.orders.selectExpr("o_custkey k"), t.customer.selectExpr("c_custkey k"))


@query("set_03_flag_union", "SELECT event_id, coalesce(value > 120, false) OR coalesce(value < 1, false) OR event_type = 'error' AS flagged FROM " + "events")
def union_flags(t):
    return t.events.select("event_id", s.any_flag([F.col("value") > 120, F.col("value") < 1, F.col("event_type") == "error"]).alias("flagged"))


@query("cln_01_impute_median", f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {HOLES_SQL})), 4) AS value FROM {HOLES_SQL}")
def median(t):
    return rounded(q.impute(holes(t), ["value"]).select("event_id", "value"), 4)


@query("cln_01_impute_nearest", f"""
    WITH h AS (SELECT e.event_type, o.* FROM {HOLES_SQL} o JOIN events e USING (event_id)), k AS (SELECT event_type, epoch_us(ts) AS x, avg(value) AS v FROM h WHERE value IS NOT NULL GROUP BY 1, 2),
         w AS (SELECT event_id, event_type, epoch_us(ts) AS spot FROM h WHERE value IS NULL), d AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - spot), x) AS p FROM w JOIN k USING (event_type))
    SELECT event_id, round(coalesce(value, f), 6) AS value FROM h LEFT JOIN (SELECT event_id, avg(v) AS f FROM d WHERE p <= 3 GROUP BY 1) USING (event_id)""")
def nearest(t):
    e = t.events.selectExpr("event_id", "event_type", "unix_micros(cast(ts as timestamp)) at", "if(event_id % 3 <> 0, value, null) value")
    return rounded(q.impute_nearest(e, "event_id", ["event_type"], "value", "at", 3).select("event_id", "value"))


def _nan_euclidean(target: str) -> str:
    """SQL: the fill of one column: the mean over the five rows nearest by the features known on both sides."""
    others = [c for c in "abc" if c != target]
    total = " + ".join(f"coalesce(pow(x.{c} - y.{c}, 2), 0)" for c in others)
    shared = " + ".join(f"(x.{c} IS NOT NULL AND y.{c} IS NOT NULL)::INT" for c in others)
    spots = f"(SELECT {', '.join(others)}, min(id) AS id, count(*) AS w, avg({target}) AS v FROM h WHERE {target} IS NOT NULL GROUP BY ALL)"
    return f"""(SELECT id, sum(v * u) / sum(u) AS {target} FROM (SELECT id, e.v, greatest(0, least(e.w, 5 - coalesce(sum(e.w) OVER (PARTITION BY id ORDER BY e.d, e.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS u
        FROM (SELECT x.id, unnest(min({{'d': ({total}) * 3 / ({shared}), 'j': y.id, 'w': y.w, 'v': y.v}}, 5)) AS e FROM h x JOIN {spots} y ON x.{target} IS NULL AND {shared} > 0 GROUP BY x.id)) GROUP BY id)"""


@query("cln_01_impute_neighbours", f"""
    WITH h AS MATERIALIZED (SELECT id, CASE WHEN id % 7 <> 0 THEN a END AS a, CASE WHEN id % 5 <> 1 THEN b END AS b, CASE WHEN id % 11 <> 2 THEN c END AS c
                            FROM {standard_sql(source="(SELECT event_id, sqrt(a) AS a, sqrt(b) AS b, c FROM " + READINGS + ")")})
    SELECT h.id AS event_id, round(coalesce(h.a, fa.a, (SELECT avg(a) FROM h)), 6) + 0.0::DOUBLE AS a, round(coalesce(h.b, fb.b, (SELECT avg(b) FROM h)), 6) + 0.0::DOUBLE AS b, round(coalesce(h.c, fc.c, (SELECT avg(c) FROM h)), 6) + 0.0::DOUBLE AS c
    FROM h LEFT JOIN {_nan_euclidean('a')} fa USING (id) LEFT JOIN {_nan_euclidean('b')} fb USING (id) LEFT JOIN {_nan_euclidean('c')} fc USING (id)""")
def neighbours(t):
    """Standardised readings with holes; some rows miss two features."""
    e = space.scaled(readings(t).withColumns({c: F.sqrt(c) for c in "ab"}), ["a", "b", "c"]).select("event_id", *[F.when(F.col("event_id") % m != r_, F.col("vec")[j]).alias(c) for j, (c, m, r_) in enumerate((("a", 7, 0), ("b", 5, 1), ("c", 11, 2)))])
    return rounded(q.impute_neighbours(e, "event_id", ["a", "b", "c"]).select("event_id", "a", "b", "c"))


@query("cln_02_impute_mode", """
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, (SELECT c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment FROM customer""")
def mode(t):
    return q.impute_mode(t.customer.selectExpr("c_custkey", "if(c_custkey % 5 <> 0, c_mktsegment, null) segment"), ["segment"])


FENCE = "(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"


@query("cln_03_cap_outliers", f"SELECT event_id, round(least(hi, greatest(lo, value)), 5) AS value FROM events, {FENCE}")
def cap(t):
    return rounded(q.cap_outliers(t.events.select("event_id", "value"), ["value"]), 5)


@query("cln_04_drop_outliers", f"""
    WITH a AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * value AS kv FROM events, {FENCE} WHERE value BETWEEN lo AND hi),
         f AS (SELECT quantile_cont(kv, 0.25) AS q1, quantile_cont(kv, 0.75) AS q3 FROM a)
    SELECT event_id FROM a, f WHERE kv BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def drop(t):
    e = t.events.select("event_id", "value", (F.get_json_object("props", "$.k").cast("double") * F.col("value")).alias("kv"))
    return q.drop_outliers(e, ["value", "kv"]).select("event_id")


@query("cln_04_drop_outliers_z", "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) <= 2")
def drop_z(t):
    return q.drop_outliers(t.events, ["value"], "zscore", 2.0).select("event_id")


LIMITS = [("l_quantity", 2.0, 45.0, 5.0, 40.0), ("l_discount", 0.0, 0.2, 0.01, 0.08), ("l_extendedprice", 1000.0, 90000.0, 5000.0, 80000.0)]


@query("cln_05_constraint_report", " UNION ALL ".join(f"""
    SELECT '{c}' AS parameter, count(*) FILTER ({c} < {a}) AS below, count(*) FILTER ({c} > {b}) AS above, count(*) FILTER ({c} BETWEEN {a} AND {b} AND ({c} < {x} OR {c} > {y})) AS atypical, count(*) FILTER ({c} < 0) AS negative,
           count(*) FILTER ({c} IS NULL) AS missing, count(*) AS total, CASE WHEN count(*) FILTER ({c} < {a} OR {c} > {b}) > 0 THEN 'critical' WHEN count(*) FILTER ({c} < {x} OR {c} > {y}) > 0 THEN 'warning' ELSE 'info' END AS severity FROM lineitem""" for c, a, b, x, y in LIMITS))
def constraints(t):
    return q.constraint_report(t.lineitem, LIMITS)


@query("cln_06_lenient_clip", "SELECT l_orderkey, l_linenumber, l_partkey, least(45.0, greatest(2.0, l_quantity))::DOUBLE AS l_quantity FROM lineitem")
def lenient(t):
    return clip(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), {n: (a, b) for n, a, b, *_ in LIMITS[:1]})


@query("cln_07_physics_checks", """
    SELECT 'temperature_ratio' AS rule, count(*) FILTER (l_discount / nullif(l_tax, 0) < 0.5 OR l_discount / nullif(l_tax, 0) > 3) AS violations FROM lineitem
    UNION ALL SELECT 'density_limit', count(*) FILTER (l_extendedprice > l_quantity * 20000 / (pi() * 4) * 1.2) FROM lineitem
    UNION ALL SELECT 'beta_limit', count(*) FILTER (l_discount > 0.028 * l_quantity / (2 * nullif(l_linenumber, 0)) * 1.1) FROM lineitem""")
def physics(t):
    return f.rule_counts(t.lineitem, q.physics_checks(t.lineitem, "l_discount", "l_tax", "l_extendedprice", "l_quantity", "l_discount", "l_linenumber", 20000.0))


@query("cln_08_outlier_methods", """
    WITH s AS (SELECT count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, s),
         g AS (SELECT value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS a, abs((value - m) / sd) > 3 AS b, abs(0.6745 * (value - med) / mad) > 3.5 AS c FROM events, s, d)
    SELECT count(*) AS n, count(*) FILTER (a) AS iqr_flag, count(*) FILTER (b) AS z_flag, count(*) FILTER (c) AS modified_z_flag, count(*) FILTER (a OR b OR c) AS outlier,
           CASE WHEN count(*) FILTER (a OR b OR c) = 0 THEN 'none' WHEN count(*) FILTER (a OR b OR c) > count(*) * 0.1 THEN 'critical' ELSE 'warning' END AS severity FROM g""")
def outliers(t):
    return q.outlier_report(t.events.select("value"), "value")


def issues(t):
    return q.issue_table(t.events, [
        ("critical", "user_id", "no user", F.col("user_id").isNull()), ("critical", "value", "above 150", F.col("value") > 150),
        ("warning", "value", "below 1", F.col("value") < 1), ("info", "event_type", "error event", F.col("event_type") == "error")])


ISSUES_SQL = """(SELECT 'critical' AS severity, 'value' AS field, 'above 150' AS message, count(*) FILTER (value > 150) AS count FROM events UNION ALL SELECT 'warning', 'value', 'below 1', count(*) FILTER (value < 1) FROM events
    UNION ALL SELECT 'info', 'event_type', 'error event', count(*) FILTER (event_type = 'error') FROM events)"""


@query("cln_09_issue_table", f"SELECT * FROM {ISSUES_SQL} WHERE count > 0")
def issue_table(t):
    return issues(t)


@query("cln_09_issue_summary", f"SELECT count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'critical') = 0 AS valid FROM {ISSUES_SQL} WHERE count > 0")
def issue_summary(t):
    return q.issue_summary(issues(t))


@query("cln_10_quality_gate", """
    SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS missing, coalesce(sum((abs((v - m) / s) > 5)::INT), 0)::BIGINT > count(*) * 0.05 AS warns
    FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN value END AS v FROM events), (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_id % 50 <> 0)""")
def gate(t):
    e = t.events.selectExpr("event_id", "if(event_id % 50 <> 0, value, null) value")
    got = q.quality_gate(e, ["value"])
    return e.agg(F.count(F.lit(1)).alias("rows")).withColumns({"missing": F.lit(got["missing"]).cast("bigint"), "warns": F.lit(bool(got["warn"]))})


SCALED = ["p_retailprice", "p_size"]


@query("cln_11_standard_scaling", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0::DOUBLE AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) + 0.0::DOUBLE AS p_size FROM part")
def standard(t):
    return rounded(q.scale(t.part.select("p_partkey", *SCALED), SCALED))


@query("cln_11_minmax_scaling", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 7) AS p_retailprice, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 7) AS p_size FROM part")
def minmax(t):
    return rounded(q.scale(t.part.select("p_partkey", *SCALED), SCALED, "minmax"), 7)


@query("cln_11_robust_scaling", "SELECT p_partkey, round((p_retailprice - (SELECT median(p_retailprice) FROM part)) / (SELECT quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) FROM part), 6) + 0.0::DOUBLE AS p_retailprice, round((p_size - (SELECT median(p_size) FROM part)) / (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) FROM part), 6) + 0.0::DOUBLE AS p_size FROM part")
def robust(t):
    return rounded(q.scale(t.part.select("p_partkey", *SCALED), SCALED, "robust"))


FEATS = ["l_quantity", "l_discount", "l_tax"]


@query("cln_12_f_selection", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(k * k / (1 - k * k) * (n - 2), 4) AS f_score FROM (SELECT corr({c}, l_extendedprice) AS k, count(*) AS n FROM lineitem)" for c in FEATS) + ") ORDER BY f_score DESC LIMIT 2")
def f_selection(t):
    return rounded(q.select_by_f(t.lineitem, FEATS, "l_extendedprice", 2), 4)


def _mi_sql(c):
    cut = lambda x: f"least(floor(({x} - (SELECT min({x}) FROM lineitem)) * 10 / (SELECT max({x}) - min({x}) FROM lineitem)), 9)"
    return f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mutual_information FROM (
        SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (SELECT {cut(c)} AS x, {cut('l_extendedprice')} AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2))"""


@query("cln_13_mutual_information", " UNION ALL ".join(_mi_sql(c) for c in FEATS))
def mutual(t):
    return rounded(q.mutual_information(t.lineitem.select("l_extendedprice", "l_quantity", (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax")), FEATS, "l_extendedprice"))


def _digamma(x: str) -> str:
    y = f"({x} + 8.0::DOUBLE)"
    i = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5::DOUBLE / {y} - {i} * (1 / 12 - {i} * (1 / 120 - {i} * (1 / 252 - {i} * (1 / 240 - {i} / 132)))) - ({' + '.join(f'1 / ({x} + {j})' for j in range(8))}))"


def _nearest_mi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(greatest(0, {_digamma('any_value(n)::DOUBLE')} + 1.5 - 0.5772156649015329 - avg({_digamma('nx::DOUBLE')}) - avg({_digamma('ny::DOUBLE')})), 6) AS mutual_information FROM (
        SELECT p.id, any_value(total) AS n, count(*) FILTER (abs(p.x - o.x) <= r) AS nx, count(*) FILTER (abs(p.y - o.y) <= r) AS ny FROM (
            SELECT x.id, any_value(x.x) AS x, any_value(x.y) AS y, list_max(min(greatest(abs(x.x - y.x), abs(x.y - y.y)), 3)) * (1 - 1e-12) AS r, count(*) + 1 AS total FROM m_{c} x JOIN m_{c} y ON x.id <> y.id GROUP BY x.id) p, m_{c} o GROUP BY p.id)"""


@query("cln_13_mutual_information_nearest", "WITH " + ", ".join(f"m_{c} AS MATERIALIZED (SELECT event_id AS id, {c} / stddev_pop({c}) OVER () AS x, a / stddev_pop(a) OVER () AS y FROM {READINGS})" for c in "bc") + " " + " UNION ALL ".join(_nearest_mi(c) for c in "bc"))
def mutual_nearest(t):
    return rounded(q.mutual_information_nearest(readings(t), "event_id", ["b", "c"], "a"))


@query("cln_14_elimination")
def elimination(t):
    li = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *FEATS, "l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    got = q.eliminate(li, FEATS, "l_extendedprice", 1, trees=100)
    return t.lineitem.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("rank"), F.col("rows")) for c, k in got])).alias("c")).select("c.*")


@query("cln_15_principal_components")
def components(t):
    e = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    got, _ = q.principal_components(e, [f"e{i}" for i in range(64)], 0.95)
    return got


@query("cln_16_split", f"""
    SELECT o_orderkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'validation' ELSE 'train' END AS part FROM (SELECT o_orderkey, {portable_hash_sql(["o_orderkey"], 42)} / 4294967296.0::DOUBLE AS u FROM orders)""")
def split(t):
    return q.split(t.orders, ["o_orderkey"]).select("o_orderkey", "part")


# Scaled features by their formula up to a constant factor, which scaling takes out.
PREPARED = {
    "plasma_temperature": "t", "plasma_density": "d", "magnetic_field": "f", "thermal_energy_density": "t * d", "magnetic_pressure": "f * f",
    "plasma_frequency": "sqrt(d)", "gyrofrequency": "f", "thermal_velocity": "sqrt(t)",
}


def _prepared_sql() -> str:
    train = "FILTER (part = 'train') OVER ()"
    scaled = ", ".join(f"round(({x} - avg({x}) {train}) / stddev_pop({x}) {train}, 5) + 0.0::DOUBLE AS {c}" for c, x in PREPARED.items())
    return f"""
    WITH e AS (SELECT DISTINCT event_id, event_type, value AS t, user_id + 1.0::DOUBLE AS d, CASE WHEN event_id % 9 <> 0 THEN value / 7 END AS f, value * 2 AS q_factor, {portable_hash_sql(["event_id"], 42)} / 4294967296.0::DOUBLE AS u FROM events),
    p AS (SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'validation' ELSE 'train' END AS part FROM e), m AS (SELECT median(f) AS f FROM p WHERE part = 'train'),
    w AS (SELECT p.* EXCLUDE (f), coalesce(p.f, m.f) AS f FROM p, m)
    SELECT event_id, part, q_factor, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS event_type_index, {scaled} FROM w"""


@query("cln_17_preprocess", _prepared_sql())
def preprocess(t):
    e = t.events.selectExpr("event_id", "event_type", "value plasma_temperature", "user_id + 1.0D plasma_density", "if(event_id % 9 = 0, null, value / 7) magnetic_field", "value * 2 q_factor")
    got = q.preprocess(e, "event_id", "q_factor", ["event_type"])
    return rounded(got.select("event_id", "part", "q_factor", "event_type_index", *PREPARED), 5, q_factor=9)


@query("cln_18_event_transforms", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS reading, 'lab' AS site, 'user-' || user_id AS user FROM events""")
def transforms(t):
    body = F.from_json("props", "k bigint").withField("user", F.col("user_id").cast("string")).withField("junk", F.lit(1))
    out = ev.transform_payload(t.events.withColumn("data", body), "data", [("rename", "k", "reading"), ("add", "site", "lab"), ("remove", "junk", None), ("format", "user", "user-%s")])
    return out.select("event_id", F.from_json(F.to_json("data"), "reading bigint, site string, user string").alias("d")).select("event_id", "d.*")


@query("cln_19_compliance_rules", """
    SELECT event_id, 'data_access_logged' AS rule FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 UNION ALL SELECT event_id, 'access_control' FROM events WHERE event_type = 'signup' AND user_id % 2 = 0
    UNION ALL SELECT event_id, 'failed_login_monitoring' FROM events WHERE event_type = 'error' AND value > 20 UNION ALL SELECT event_id, 'monitoring' FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'privileged_access' FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0""")
def compliance(t):
    e = t.events.selectExpr(
        "event_id", "case event_type when 'view' then 'data_access' when 'signup' then 'access_denied' when 'error' then 'login_failure' when 'purchase' then 'access_granted' else 'other' end kind",
        "if(event_id % 10 = 0, null, user_id) user_id", "cast(null as string) ip_address", "event_type", "user_id uid", "value")
    keys = F.expr("""array_compact(array(if(uid % 3 = 0, 'resource', null), 'action', 'user_id', if(event_type = 'purchase' or uid % 2 = 1, 'authorization_check', null), if(value <= 20, 'attempt_count', null)))""")
    roles = F.expr("if(event_type = 'purchase' and uid % 7 = 0, array('admin'), array())").cast("array<string>")
    return ev.compliance_violations(e.withColumns({"details": keys, "roles": roles}), "event_id", "kind", "user_id", "ip_address", "details", "roles")


@query("cln_20_integrity_hash", "SELECT event_id, sha256('=' || event_id || '|=' || event_type || '|=' || user_id) AS hash, event_id % 10 <> 0 AS intact FROM events")
def integrity(t):
    """Every tenth row is changed after its hash was taken."""
    kept = t.events.withColumn("hash", row_hash(["event_id", "event_type", "user_id"]))
    later = kept.withColumn("user_id", F.when(F.col("event_id") % 10 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return later.select("event_id", "hash", (F.col("hash") == row_hash(["event_id", "event_type", "user_id"])).alias("intact"))
