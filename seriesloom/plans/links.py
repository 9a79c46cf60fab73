"""Queries for joins, picks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import joins as J
from seriesloom.operators import select as K
from seriesloom.plans.registry import query, rnd, sql_rnd
from seriesloom.plans.scores import ESTIMATORS, FC, forecasts, rounded


@query(
    "j01_enrich_or_fail",
    f"""SELECT c_custkey, n_name, n_regionkey, {sql_rnd('c_acctbal * (0.8 + n_regionkey / 50)')} AS corrected
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def j01(t):
    d = J.enrich_or_fail(t.customer, t.nation, "c_nationkey", ["n_name", "n_regionkey"], "n_nationkey")
    corrected = F.col("c_acctbal") * (0.8 + F.col("n_regionkey") / 50)
    return d.select("c_custkey", "n_name", "n_regionkey", rnd(corrected).alias("corrected"))


@query(
    "j02_enrich_keep",
    """SELECT event_id, user_id, o.o_orderstatus AS status, o.o_totalprice AS price
    FROM events LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = event_id""",
)
def j02(t):
    rows = t.events.select("event_id", "user_id", F.lit("stale").alias("status"))
    side = t.orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )
    return J.enrich(rows, side, "event_id", ["status", "price"], "o_orderkey")


@query(
    "j03_one_to_one_truth",
    f"""WITH p AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS estimate FROM events GROUP BY 1, 2),
    q AS (SELECT user_id, event_type, max(value) AS truth FROM events WHERE value > 12 GROUP BY 1, 2)
    SELECT user_id, event_type, n, {sql_rnd('estimate')} AS estimate, truth FROM p JOIN q USING (user_id, event_type)""",
)
def j03(t):
    keys = ["user_id", "event_type"]
    left = t.events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("estimate")
    )
    right = t.events.filter("value > 12").groupBy(*keys).agg(F.max("value").alias("truth"))
    return J.one_to_one(left, right, keys)


@query(
    "j04_same_day",
    f"""WITH a AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
    b AS (SELECT DISTINCT o_custkey, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT o_custkey, d AS match_date, {sql_rnd('total', 2)} AS total FROM a JOIN b USING (o_custkey, d)""",
)
def j04(t):
    day = F.to_date("o_orderdate").cast("timestamp_ntz").alias("order_time")
    left = t.orders.groupBy("o_custkey", day).agg(rnd(F.sum("o_totalprice"), 2).alias("total"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    right = lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        "o_custkey", F.to_date("l_shipdate").cast("timestamp_ntz").alias("ship_time")
    ).distinct()
    return J.same_day(left, right, ["o_custkey"], "order_time", "ship_time").select(
        "o_custkey", "match_date", "total"
    )


@query(
    "j05_dictionary_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10""",
)
def j05(t):
    side = t.part.filter("p_size > 10")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return J.enrich(rows, side, "l_partkey", ["p_brand", "p_size"], "p_partkey")


@query(
    "j06_semi_join",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def j06(t):
    passed = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(passed, "l_orderkey", "left_semi")


@query(
    "j07_key_differences",
    """SELECT doc_id, 'right' AS missing_from FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'left' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
)
def j07(t):
    return J.key_differences(t.documents, t.labels, ["doc_id"])


@query(
    "j08_best_earlier_fit",
    """WITH f AS (SELECT user_id, ts, CAST(event_id % 9 AS BIGINT) + 4 AS n_landmarks, floor(value) AS span_px, value / 20 AS rmse,
      'img' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS filename FROM events WHERE event_type = 'view'),
    r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
    c AS (SELECT r.event_id, r.user_id, f.filename, f.ts AS fit_time, f.rmse, f.n_landmarks, row_number() OVER (PARTITION BY r.event_id
      ORDER BY CASE WHEN rmse <= 1.27 THEN 0 ELSE 1 END, f.n_landmarks DESC, span_px DESC, rmse, f.ts, filename) AS i
      FROM r LEFT JOIN f ON f.user_id = r.user_id AND f.ts <= r.ts)
    SELECT event_id, user_id, filename AS fit_filename, fit_time, rmse AS fit_rmse, n_landmarks AS fit_landmarks FROM c WHERE i = 1""",
)
def j08(t):
    e = t.events
    fits = e.filter("event_type = 'view'").select(
        "user_id",
        "ts",
        (F.col("event_id") % 9 + 4).alias("n_landmarks"),
        F.floor("value").cast("double").alias("span_px"),
        (F.col("value") / 20).alias("rmse"),
        F.concat(F.lit("img"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("filename"),
    ).withColumn("fit_landmarks", F.col("n_landmarks"))
    rows = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return J.best_earlier_fit(rows, fits, "user_id", "ts", ["event_id"], ["fit_landmarks"]).drop("ts")


@query(
    "j09_token_match",
    r"""SELECT page_id, tok AS source_id FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(replace(url, '.', '..'), '\.([^._]+)[._]', 1))) AS tok FROM pages)
    WHERE tok IN (SELECT DISTINCT regexp_extract(url, '\.([a-z]+)\.', 1) FROM pages)""",
)
def j09(t):
    names = t.pages.select("page_id", "url")
    ids = t.pages.select(F.regexp_extract("url", r"\.([a-z]+)\.", 1).alias("source_id")).distinct()
    return J.token_match(names, ids, "url", "source_id").select("page_id", "source_id")


@query(
    "j10_pair_length_errors",
    f"""WITH r AS (SELECT l_orderkey, l_quantity AS truth, l_quantity + l_discount * 90 AS pred, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS i FROM lineitem),
    p AS (SELECT a.l_orderkey, abs(b.pred - a.pred) - abs(b.truth - a.truth) AS e FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.i < b.i)
    SELECT l_orderkey, count(*) AS pairs, {sql_rnd('avg(e)')} AS bias, {sql_rnd('avg(abs(e))')} AS mae, {sql_rnd('sqrt(avg(e * e))', 4)} AS rmse FROM p GROUP BY 1""",
)
def j10(t):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("truth"),
        (F.col("l_quantity") + F.col("l_discount") * 90).alias("pred"),
    )
    d = J.pair_length_errors(rows, ["l_orderkey"], "truth", "pred", ["l_linenumber", "l_partkey"])
    return rounded(d, rmse=4)


@query(
    "j14_truth_after_prediction",
    f"""WITH {FC}, truth AS (SELECT event_id, max(value) AS manual FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT event_id, {sql_rnd('last_observation - manual')} AS left_error, {sql_rnd('two_point_line - manual')} AS right_error
    FROM fc JOIN truth USING (event_id)""",
)
def j14(t):
    truth = t.events.filter("event_type <> 'error'").select("event_id", F.col("value").alias("manual"))
    both = forecasts(t).filter(" AND ".join(f"{e} IS NOT NULL" for e in ESTIMATORS))
    d = both.select("event_id", *ESTIMATORS).join(truth, "event_id")
    return d.select(
        "event_id",
        rnd(F.col("last_observation") - F.col("manual")).alias("left_error"),
        rnd(F.col("two_point_line") - F.col("manual")).alias("right_error"),
    )


# --- picks ----------------------------------------------------------------------------------------


@query(
    "k01_stable_order",
    """SELECT user_id, event_id, ts, value FROM events ORDER BY user_id, ts, event_id""",
)
def k01(t):
    return K.stable_order(t.events.select("user_id", "event_id", "ts", "value"), ["user_id", "ts", "event_id"])


@query(
    "k02_top_per_group",
    """SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 250""",
)
def k02(t):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return K.top_k(rows, ["l_suppkey"], order, 250)


@query(
    "k03_spaced_top_k",
    """WITH RECURSIVE c AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer),
    g AS (SELECT c_nationkey, i, [c_acctbal] AS xs, [c_custkey] AS ids FROM c WHERE i = 1
      UNION ALL SELECT c.c_nationkey, c.i,
        CASE WHEN len(xs) < 6 AND len(list_filter(xs, lambda x: abs(x - c_acctbal) < 350)) = 0 THEN list_append(xs, c_acctbal) ELSE xs END,
        CASE WHEN len(xs) < 6 AND len(list_filter(xs, lambda x: abs(x - c_acctbal) < 350)) = 0 THEN list_append(ids, c_custkey) ELSE ids END
      FROM g JOIN c ON c.c_nationkey = g.c_nationkey AND c.i = g.i + 1),
    l AS (SELECT c_nationkey, arg_max(xs, i) AS xs, arg_max(ids, i) AS ids FROM g GROUP BY 1)
    SELECT c_nationkey, CAST(unnest(range(1, 7)) AS INTEGER) AS pick, unnest(xs) AS c_acctbal, unnest(ids) AS c_custkey FROM l WHERE len(xs) = 6""",
)
def k03(t):
    order = [(-F.col("c_acctbal")).alias("o1"), F.col("c_custkey").alias("o2")]
    return K.spaced_top_k(t.customer, ["c_nationkey"], "c_acctbal", order, ["c_custkey"], 6, 350.0)


@query(
    "k04_prior_weighted_pick",
    """WITH w AS (SELECT l_orderkey, l_quantity, l_linenumber * 100000000 + l_partkey AS tie, l_discount + 0.01 AS conf, exp(-0.5 * ((l_quantity - 25) / 8.0) ** 2) / 8 AS lik FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, tie) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf * lik DESC, tie) AS b FROM w)
    SELECT l_orderkey, max(CASE WHEN a = 1 THEN l_quantity END) AS most_confident, max(CASE WHEN b = 1 THEN l_quantity END) AS prior_weighted FROM r GROUP BY 1""",
)
def k04(t):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_quantity",
        (F.col("l_linenumber") * F.lit(100000000).cast("bigint") + F.col("l_partkey")).alias("tie"),
        (F.col("l_discount") + 0.01).alias("conf"),
        F.lit(25.0).alias("mean"),
        F.lit(8.0).alias("sd"),
    )
    return K.pick_by_confidence(rows, ["l_orderkey"], "l_quantity", "conf", "mean", "sd", "tie")


_NEAR = lambda p, used: f"""SELECT {p}::DOUBLE AS probability, c_custkey, c_acctbal, q AS target, abs(c_acctbal - q) AS distance
    FROM customer, (SELECT quantile_cont(c_acctbal, {p}) AS q FROM customer) WHERE c_custkey NOT IN ({used}) ORDER BY abs(c_acctbal - q), c_custkey LIMIT 1"""  # noqa: E731


@query(
    "k05_nearest_to_quantiles",
    f"""WITH a AS ({_NEAR(0.1, '-1')}), b AS ({_NEAR(0.5, 'SELECT c_custkey FROM a')}), c AS ({_NEAR(0.9, 'SELECT c_custkey FROM a UNION SELECT c_custkey FROM b')})
    SELECT probability, c_custkey, c_acctbal, {sql_rnd('target', 4)} AS target, {sql_rnd('distance', 4)} AS distance FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""",
)
def k05(t):
    d = K.nearest_to_quantiles(t.customer, "c_custkey", "c_acctbal", [0.1, 0.5, 0.9])
    return d.withColumns({"target": rnd("target", 4), "distance": rnd("distance", 4)})


@query(
    "k06_first_entities",
    "SELECT user_id, event_id, value FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 9)",
)
def k06(t):
    return K.first_entities(t.events.select("user_id", "event_id", "value"), "user_id", 9)


# --- sets -----------------------------------------------------------------------------------------


@query(
    "u01_union_results",
    """SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""",
)
def u01(t):
    count = lambda d, kind, key: d.groupBy(F.col(key).alias("nation")).agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")
    )
    return count(t.customer, "customer", "c_nationkey").unionByName(count(t.supplier, "supplier", "s_nationkey"))


@query(
    "u02_common_keys",
    """SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages""",
)
def u02(t):
    return K.common_keys([t.documents, t.labels, t.pages.withColumnRenamed("page_id", "doc_id")], ["doc_id"])


@query(
    "u03_shared_entities",
    """SELECT user_id FROM events WHERE event_type = 'error' AND value > 60 INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND value > 60""",
)
def u03(t):
    side = lambda kind: t.events.filter((F.col("event_type") == kind) & (F.col("value") > 60))
    return K.shared_entities(side("error"), side("view"), "user_id")


@query("u04_keys_minus", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04(t):
    return K.keys_minus(t.documents, t.labels, ["doc_id"])


@query("u05_keys_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u05(t):
    return K.keys_union(
        t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), ["k"]
    )


@query("u06_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def u06(t):
    return t.events.select("user_id", "event_type").dropDuplicates()
