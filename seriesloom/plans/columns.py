"""Queries for contracts, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import scalars as C
from seriesloom.functions import scoring as S
from seriesloom.operators import contracts as P
from seriesloom.operators.ordering import previous
from seriesloom.operators.windows import elapsed_days
from seriesloom.plans.registry import EVENT_ORDER, EVENT_WINDOW, query, rnd, sql_rnd
from seriesloom.plans.scores import OUTLIER, OUTLIER_SD, sql_phi
from seriesloom.session import materialize

# A text column with several spellings of a flag, derived from the event type.
FLAG_SQL = """CASE event_type WHEN 'view' THEN ' True' WHEN 'click' THEN '1' WHEN 'signup' THEN 'YES '
    WHEN 'error' THEN 'no' END"""


def flagged(t):
    return t.events.withColumn(
        "quality",
        F.when(F.col("event_type") == "view", " True")
        .when(F.col("event_type") == "click", "1")
        .when(F.col("event_type") == "signup", "YES ")
        .when(F.col("event_type") == "error", "no"),
    )


@query(
    "p02_coerce",
    """WITH r AS (SELECT event_id, (props ->> '$.k') || CASE WHEN event_type = 'error' THEN 'x' ELSE '' END AS num_text,
      '2024-01-' || lpad(CAST((props ->> '$.k')::INT % 40 AS VARCHAR), 2, '0') || ' 10:00:00' AS time_text FROM events)
    SELECT event_id, try_cast(num_text AS DOUBLE) AS number, try_cast(time_text AS TIMESTAMP) AS moment FROM r""",
)
def p02(t):
    k = F.get_json_object("props", "$.k")
    rows = t.events.select(
        "event_id",
        F.concat(k, F.when(F.col("event_type") == "error", "x").otherwise("")).alias("number"),
        F.concat(
            F.lit("2024-01-"),
            F.lpad((k.cast("int") % 40).cast("string"), 2, "0"),
            F.lit(" 10:00:00"),
        ).alias("moment"),
    )
    return P.coerce_timestamp(P.coerce_numeric(rows, ["number"]), ["moment"])


@query(
    "p03_truthy_flag",
    f"SELECT event_id, coalesce(lower(trim({FLAG_SQL})) IN ('true', '1', 'yes'), false) AS flag FROM events",
)
def p03(t):
    return flagged(t).select("event_id", C.truthy(F.col("quality")).alias("flag"))


@query(
    "p04_eligible",
    f"""SELECT event_id, user_id, value FROM events
    WHERE nullif(user_id, 3) IS NOT NULL AND nullif(value, 10) IS NOT NULL
      AND lower(trim({FLAG_SQL})) IN ('true', '1', 'yes')""",
)
def p04(t):
    rows = flagged(t).withColumns(
        {"user_id": F.nullif("user_id", F.lit(3)), "value": F.nullif("value", F.lit(10.0))}
    )
    return P.eligible(rows, ["user_id"], "value", "quality").select("event_id", "user_id", "value")


@query(
    "p05_composite_key",
    """SELECT CAST(user_id AS VARCHAR) || '::' || event_type AS entity, count(*) AS n FROM events GROUP BY 1""",
)
def p05(t):
    key = P.composite_key(["user_id", "event_type"]).alias("entity")
    return t.events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p06_normalize_dates",
    """WITH b AS (SELECT 'img' || event_id AS filename FROM events),
    d AS (SELECT 'img' || o_orderkey AS filename, strftime(o_orderdate, '%Y-%m-%d') AS d,
          CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS c FROM orders WHERE o_orderstatus <> 'P')
    SELECT b.filename, coalesce(d, '') AS capture_datetime, coalesce(c, 'camera_1') AS camera_id
    FROM b LEFT JOIN d USING (filename)""",
)
def p06(t):
    base = t.events.select(F.concat(F.lit("img"), "event_id").alias("filename"))
    supplied = t.orders.filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("upload/img"), "o_orderkey").alias(" Image"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("plot"),
    )
    return P.normalize_dates(supplied, base)


_BOX_SQL = """b0 AS (SELECT l_orderkey, l_linenumber, l_partkey,
      (l_partkey % 700 - 20)::DOUBLE AS bx1, (l_suppkey % 50 - 5)::DOUBLE AS by1,
      (l_partkey % 700 - 20) + l_quantity * 3 AS bx2, (l_suppkey % 50 - 5) + l_extendedprice / 200 AS by2 FROM lineitem),
    b1 AS (SELECT *, greatest(least(bx1, 639), 0) AS x1, greatest(least(bx2, 639), 0) AS x2,
      greatest(least(by1, 479), 0) AS y1, greatest(least(by2, 479), 0) AS y2 FROM b0),
    b2 AS (SELECT *, least(greatest(bx1 - 4, x1), x2) AS xt, least(greatest(by1 + 3, y1), y2) AS yt,
      least(greatest(bx2 + 2, x1), x2) AS xr, least(greatest(by2 - 1, y1), y2) AS yr FROM b1 WHERE x2 > x1 AND y2 > y1),
    b3 AS (SELECT *, greatest(yr - yt, 0) AS h FROM b2)"""


def boxes(t):
    x1 = (F.col("l_partkey") % 700 - 20).cast("double")
    y1 = (F.col("l_suppkey") % 50 - 5).cast("double")
    x2, y2 = x1 + F.col("l_quantity") * 3, y1 + F.col("l_extendedprice") / 200
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        x1.alias("box_x1"), y1.alias("box_y1"), x2.alias("box_x2"), y2.alias("box_y2"),
        (x1 - 4).alias("x_top"), (y1 + 3).alias("y_top"), (x2 + 2).alias("x_root"), (y2 - 1).alias("y_root"),
        F.lit(640).alias("image_width"), F.lit(480).alias("image_height"),
    )


@query(
    "p07_clean_candidates",
    f"""WITH {_BOX_SQL} SELECT l_orderkey, l_linenumber, l_partkey, x1 AS box_x1, y1 AS box_y1, x2 AS box_x2,
      y2 AS box_y2, xt AS x_top, yt AS y_top, xr AS x_root,
      yr AS y_root, h AS height_px FROM b3
    WHERE h >= 20 AND yr >= 0.35 * 480 AND x2 - x1 >= 5 AND (y2 - y1) / greatest(x2 - x1, 1) BETWEEN 0.4 AND 25""",
)
def p07(t):
    d = P.clean_candidates(materialize(boxes(t)))  # a stored candidate table
    names = ["box_x1", "box_y1", "box_x2", "box_y2", "x_top", "y_top", "x_root", "y_root", "height_px"]
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *names)


_CAL_SQL = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount,
      l_extendedprice / 200 AS y_top, l_extendedprice / 200 + l_quantity * 9 AS y_root, 60.0::DOUBLE AS low, 400.0::DOUBLE AS high, 30.0::DOUBLE AS gap FROM lineitem),
    n AS (SELECT *, greatest(low - y_top, y_top - high, low - y_root, y_root - high, 0) / gap AS bands,
      (-40 * (y_top - 230) / 100 + 120) / (0.02 * (y_top - 230) / 100 + 1) AS top_cm,
      (-40 * (y_root - 230) / 100 + 120) / (0.02 * (y_root - 230) / 100 + 1) AS root_cm FROM m),
    q AS (SELECT *, (top_cm - root_cm) * 0.85 AS height FROM n)"""


def calibrated(t):
    top = F.col("l_extendedprice") / 200
    rows = t.lineitem.withColumns({"y_top": top, "y_root": top + F.col("l_quantity") * 9})
    fit = [F.lit(x) for x in (-40.0, 120.0, 0.02, 230.0, 100.0)]
    bands = C.extrapolation_bands(
        F.col("y_top"), F.col("y_root"), F.lit(60.0), F.lit(400.0), F.lit(30.0)
    )
    height = C.projective_height(F.col("y_top"), *fit) - C.projective_height(F.col("y_root"), *fit)
    return rows.withColumns({"bands": bands, "height": height * 0.85})


@query(
    "p08_measurement_qc",
    f"""WITH {_CAL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 'no_past_passing_pole_calibration'
      WHEN NOT (height > 0 AND height <= 450) THEN 'height_out_of_range' WHEN bands > 3 THEN 'pole_extrapolation_over_three_bands'
      ELSE 'pass' END AS measurement_qc FROM q""",
)
def p08(t):
    label = C.measurement_qc(F.col("height"), F.col("bands"), F.col("l_discount") != 0)
    return calibrated(t).select("l_orderkey", "l_linenumber", "l_partkey", label.alias("measurement_qc"))


@query(
    "p09_primary_quality",
    """SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity > 5 AND l_discount < 0.08 AND l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax <= 0.05) AS primary_quality
    FROM lineitem""",
)
def p09(t):
    flag = P.primary_quality(
        F.col("l_quantity") > 5,
        F.col("l_discount") < 0.08,
        F.when(F.col("l_returnflag") == "A", " Same").otherwise("nearer"),
        F.when(F.col("l_linestatus") == "F", "VERIFIED"),
        F.col("l_tax") - 0.05,
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("primary_quality"))


@query(
    "p10_split_by_year",
    """WITH y AS (SELECT *, year(o_orderdate) AS y FROM orders),
    s AS (SELECT 'all' AS split, * FROM y UNION ALL SELECT 'development', * FROM y WHERE y = 1996
      UNION ALL SELECT 'locked_test', * FROM y WHERE y = 1997)
    SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS entities, round(sum(o_totalprice), 2) AS total FROM s GROUP BY 1""",
)
def p10(t):
    return P.split_by_year(t.orders, "o_orderdate", 1996, 1997).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("o_custkey").alias("entities"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query(
    "p11_override",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      greatest(coalesce(CASE WHEN l_quantity > 10 THEN l_quantity / 20 END, 15), 1) AS sd,
      coalesce(CASE WHEN l_discount >= 0.02 AND l_discount < 0.05 THEN l_discount END, 0.08) AS outlier_probability FROM lineitem""",
)
def p11(t):
    q, p = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        C.with_override(q / 20, 15.0, q > 10, floor=1.0).alias("sd"),
        C.with_override(p, 0.08, (p >= 0.02) & (p < 0.05)).alias("outlier_probability"),
    )


@query(
    "p12_exclude_known",
    """SELECT doc_id, 'kept' AS fate FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT doc_id, 'excluded' FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)""",
)
def p12(t):
    kept, log = P.exclude_known(t.documents.select("doc_id"), t.labels.filter("toxic = 1"), "doc_id")
    return kept.select("doc_id", F.lit("kept").alias("fate")).unionByName(
        log.select("doc_id", F.lit("excluded").alias("fate"))
    )


@query(
    "p13_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def p13(t):
    return P.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "p14_count_contract",
    """SELECT 'clusters' AS what, 12::BIGINT AS expected, count(DISTINCT user_id % 12) AS observed, count(DISTINCT user_id % 12) = 12 AS ok FROM events
    UNION ALL SELECT 'types', 4, count(DISTINCT event_type), count(DISTINCT event_type) = 4 FROM events
    UNION ALL SELECT 'rows', 10000, count(*), count(*) = 10000 FROM events""",
)
def p14(t):
    return P.count_contract(
        t.events,
        {"clusters": 12, "types": 4, "rows": 10000},
        {
            "clusters": F.countDistinct(F.col("user_id") % 12),
            "types": F.countDistinct("event_type"),
            "rows": F.count(F.lit(1)),
        },
    )


# --- scalar functions ---------------------------------------------------------------------------

_NAME_SQL = """CASE event_id % 6
    WHEN 0 THEN 'in/cam_' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.jpg'
    WHEN 1 THEN strftime(ts, '%Y_%m_%d_%H_%M') || 'x.png'
    WHEN 2 THEN 'p' || strftime(ts, '%Y-%m-%d') || '.jpg'
    WHEN 3 THEN 'IMG' || strftime(ts, '%Y%m%d') || '.jpg'
    WHEN 4 THEN 'a-2024-13-41_' || strftime(ts, '%Y%m%d') || '_b.jpg'
    ELSE 'no date 9' || strftime(ts, '%Y%m%d') END"""


def image_names(t):
    f = lambda p: F.date_format("ts", p)
    form = F.col("event_id") % 6
    name = (
        F.when(form == 0, F.concat(F.lit("in/cam_"), f("yyyy-MM-dd-HH-mm-ss"), F.lit(".jpg")))
        .when(form == 1, F.concat(f("yyyy_MM_dd_HH_mm"), F.lit("x.png")))
        .when(form == 2, F.concat(F.lit("p"), f("yyyy-MM-dd"), F.lit(".jpg")))
        .when(form == 3, F.concat(F.lit("IMG"), f("yyyyMMdd"), F.lit(".jpg")))
        .when(form == 4, F.concat(F.lit("a-2024-13-41_"), f("yyyyMMdd"), F.lit("_b.jpg")))
        .otherwise(F.concat(F.lit("no date 9"), f("yyyyMMdd")))
    )
    return t.events.select("event_id", name.alias("name"))


@query(
    "f01_capture_time",
    f"""WITH n AS (SELECT event_id, regexp_extract({_NAME_SQL}, '[^/]*$') AS name FROM events),
    p AS (SELECT event_id, name,
      regexp_extract(name, '(20\\d{{2}})[-_](\\d{{2}})[-_](\\d{{2}})(?:[-_](\\d{{2}})[-_](\\d{{2}})(?:[-_](\\d{{2}}))?)?', ['y', 'm', 'd', 'h', 'i', 's']) AS a,
      regexp_extract(name, '(?:^|\\D)(20\\d{{2}})(\\d{{2}})(\\d{{2}})(?:\\D|$)', ['y', 'm', 'd']) AS b FROM n)
    SELECT event_id, coalesce(
      try_cast(CASE WHEN a.y <> '' THEN a.y || '-' || a.m || '-' || a.d || ' ' || coalesce(nullif(a.h, ''), '12') || ':' || coalesce(nullif(a.i, ''), '00') || ':' || coalesce(nullif(a.s, ''), '00') END AS TIMESTAMP),
      try_cast(CASE WHEN b.y <> '' THEN b.y || '-' || b.m || '-' || b.d || ' 12:00:00' END AS TIMESTAMP)) AS captured FROM p""",
)
def f01(t):
    return image_names(t).select("event_id", C.capture_time(F.col("name")).alias("captured"))


@query(
    "f02_header_time",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN ((date_trunc('day', ts) + to_hours(CAST(user_id % 12 +
        CASE WHEN event_id % 2 = 0 THEN 12 ELSE 0 END AS BIGINT)) + to_minutes(CAST(event_id % 60 AS BIGINT))) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC' END AS measured_utc
    FROM events""",
)
def f02(t):
    hour = F.col("user_id") % 12
    text = F.concat(
        F.month("ts"), F.lit("/"), F.dayofmonth("ts"), F.lit(" ; "),
        F.when(hour == 0, 12).otherwise(hour).cast("string"), F.lit(":"),
        F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"),
        F.when(F.col("event_id") % 2 == 0, " pm").otherwise("AM"),
    )
    text = F.when(F.col("event_type") != "error", text).otherwise("Row")
    return t.events.select(
        "event_id", C.header_time(text, 2024).cast("timestamp_ntz").alias("measured_utc")
    )


@query(
    "f03_image_keys",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 < 2 THEN 'C_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS camera,
      CASE WHEN year(o_orderdate) = 1996 THEN strftime(o_orderdate, '%m_%d') END AS day,
      CASE WHEN o_custkey % 3 = 0 THEN 'field_date_image' ELSE 'installation_reference' END AS image_role FROM orders""",
)
def f03(t):
    number = F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")
    kind = F.col("o_custkey") % 3
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = (
        F.when(kind == 0, F.concat(F.lit("C-"), number, F.lit("_"), day))
        .when(kind == 1, F.concat(F.lit("old c-"), number, F.lit("_"), day))
        .otherwise(F.concat(F.lit("D-"), number, F.lit("_"), day))
    )
    keys = C.image_keys(name, 1996)
    return t.orders.select("o_orderkey", *[v.alias(k) for k, v in keys.items()])


@query(
    "f04_pad_camera",
    "SELECT DISTINCT 'C_' || lpad(CAST(user_id % 12 AS VARCHAR), 3, '0') AS camera FROM events",
)
def f04(t):
    raw = F.concat(F.lit("C_"), F.col("user_id") % 12)
    return t.events.select(C.pad_camera(raw).alias("camera")).distinct()


@query(
    "f05_basename_safe_id",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe FROM pages""",
)
def f05(t):
    url = F.col("url")
    return t.pages.select("page_id", C.basename(url).alias("name"), C.safe_id(url).alias("safe"))


_SEED_SUM = " + ".join(
    f"('0x' || substr(h, {2 * i + 1}, 2))::HUGEINT * {256**i}" for i in range(8)
)


@query(
    "f06_digest_seed",
    f"""WITH d AS (SELECT doc_id, sha256(text) AS content_sha256, sha256('20260723|' || CAST(doc_id AS VARCHAR)) AS h FROM documents)
    SELECT doc_id, content_sha256, CAST(({_SEED_SUM}) % 4294967295 AS BIGINT) AS seed FROM d""",
)
def f06(t):
    return t.documents.select(
        "doc_id",
        F.sha2("text", 256).alias("content_sha256"),
        C.stable_seed(F.col("doc_id"), 20260723).alias("seed"),
    )


@query(
    "f07_polyline",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS x1, l_suppkey AS y1, l_linenumber * 40 AS x2, CAST(l_quantity AS BIGINT) AS y2, l_suppkey * 3 AS x3, l_suppkey AS y3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)')} AS length,
      CASE WHEN y1 <= y2 THEN x1 ELSE x2 END::DOUBLE AS top_x, least(y1, y2)::DOUBLE AS top_y,
      CASE WHEN y1 >= y2 THEN x1 ELSE x2 END::DOUBLE AS ground_x, greatest(y1, y2)::DOUBLE AS ground_y FROM p""",
)
def f07(t):
    q = F.col("l_quantity").cast("bigint")
    xy = [("l_partkey", "l_suppkey"), (F.col("l_linenumber") * 40, q), (F.col("l_suppkey") * 3, "l_suppkey")]
    text = F.concat_ws(";", *[F.concat_ws(",", x, y) for x, y in xy])
    points = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", C.polyline_points(text).alias("pts")
    )
    ends = points.select(
        "*", C.polyline_end(F.col("pts")).alias("top"), C.polyline_end(F.col("pts"), False).alias("ground")
    )
    return ends.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        rnd(C.polyline_length(F.col("pts"))).alias("length"),
        F.col("top.x").alias("top_x"),
        F.col("top.y").alias("top_y"),
        F.col("ground.x").alias("ground_x"),
        F.col("ground.y").alias("ground_y"),
    )


@query(
    "f08_elapsed_days",
    f"""WITH s AS (SELECT event_id, ts, lag(ts) OVER w AS t1, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events WINDOW w AS {EVENT_WINDOW})
    SELECT event_id, CASE WHEN t1 IS NULL THEN 0 ELSE round(greatest((epoch_us(ts) - epoch_us(t1)) / 86400000000::DOUBLE, 1e-6), 9) END AS elapsed_days,
      round((epoch_us(ts) - epoch_us(t0)) / 86400000000::DOUBLE, 6) AS days_after_first FROM s""",
)
def f08(t):
    rows = previous(t.events.select("user_id", "event_id", "ts"), EVENT_ORDER, {"t1": ("ts", 1)})
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return rows.join(first, "user_id").select(
        "event_id",
        F.round(elapsed_days("ts", "t1"), 9).alias("elapsed_days"),
        C.elapsed_from_first(F.col("ts"), F.col("t0")).alias("days_after_first"),
    )


@query(
    "f09_fixed_scale",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('greatest(l_quantity - l_linenumber * 5, 0) * 0.33')} AS extent_cm,
      {sql_rnd('l_quantity * 30.48 / 1200')} AS scale FROM lineitem""",
)
def f09(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        rnd(C.fixed_scale_extent(F.col("l_linenumber") * 5.0, F.col("l_quantity"), 0.33)).alias("extent_cm"),
        rnd(C.pinhole_scale(F.col("l_quantity") * C.FT_TO_CM, F.lit(1200.0))).alias("scale"),
    )


@query(
    "f10_projective_height",
    f"WITH {_CAL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('height')} AS height FROM q",
)
def f10(t):
    return calibrated(t).select("l_orderkey", "l_linenumber", "l_partkey", rnd("height").alias("height"))


@query(
    "f11_depth_correction",
    f"""SELECT c_custkey, {sql_rnd('c_acctbal * f')} AS corrected_height, {sql_rnd('c_acctbal * f - c_acctbal')} AS correction_shift,
      {sql_rnd('12 * f')} AS corrected_sd FROM customer JOIN (SELECT n_nationkey, 0.8 + n_regionkey / 50 AS f FROM nation) ON n_nationkey = c_nationkey""",
)
def f11(t):
    factor = t.nation.select(
        F.col("n_nationkey").alias("c_nationkey"), (0.8 + F.col("n_regionkey") / 50).alias("f")
    )
    rows = t.customer.join(factor, "c_nationkey")
    out = C.depth_correction(F.col("c_acctbal"), F.lit(12.0), F.col("f"))
    return rows.select("c_custkey", *[rnd(v).alias(k) for k, v in out.items()])


@query(
    "f12_extrapolation_bands",
    f"WITH {_CAL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('bands')} AS bands, bands > 3 AS out_of_range FROM q",
)
def f12(t):
    return calibrated(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd("bands").alias("bands"), (F.col("bands") > 3).alias("out_of_range")
    )


@query(
    "f13_measurement_sd",
    f"""WITH {_CAL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('sqrt((12 / sqrt(greatest(l_discount * 10, 0.05))) ** 2 + (sqrt(2) * l_tax * 20 * 0.85) ** 2 + (bands * 1.5) ** 2 + (abs(height) * 0.1) ** 2)')} AS measurement_sd FROM q""",
)
def f13(t):
    sd = C.measurement_sd(
        F.col("l_discount") * 10,
        F.col("l_tax") * 20,
        F.lit(0.85),
        F.col("bands"),
        F.col("height"),
        F.lit(0.1),
    )
    return calibrated(t).select("l_orderkey", "l_linenumber", "l_partkey", rnd(sd).alias("measurement_sd"))


@query(
    "f14_affine_transfer",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('4.5138 + 1.0591 * l_quantity * 0.33 * (9.0 / 7.5)')} AS transferred FROM lineitem",
)
def f14(t):
    moved = C.affine_transfer(F.col("l_quantity"), F.lit(4.5138), F.lit(1.0591), 0.33, 9.0 / 7.5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rnd(moved).alias("transferred"))


_MIX = f"""z AS (SELECT event_id, value, (value - 20) / 15.0::DOUBLE AS zi, (value - 20) / {OUTLIER_SD}::DOUBLE AS zo FROM events),
    d AS (SELECT *, {1 - OUTLIER!r}::DOUBLE * exp(-0.5 * zi * zi) / 15 / sqrt(2 * pi()) AS di,
      {OUTLIER}::DOUBLE * exp(-0.5 * zo * zo) / {OUTLIER_SD}::DOUBLE / sqrt(2 * pi()) AS do_ FROM z)"""
_MIX_ARGS = lambda: (F.col("value"), F.lit(20.0), F.lit(15.0), F.lit(OUTLIER), F.lit(OUTLIER_SD))


@query(
    "f15_mixture_log_density",
    f"""WITH {_MIX} SELECT event_id, {sql_rnd('ln(di + do_)')} AS log_density, {sql_rnd('do_ / (di + do_)')} AS responsibility FROM d""",
)
def f15(t):
    return t.events.select(
        "event_id",
        rnd(S.mixture_log_density(*_MIX_ARGS())).alias("log_density"),
        rnd(S.outlier_responsibility(*_MIX_ARGS())).alias("responsibility"),
    )


@query(
    "f16_mixture_cdf",
    f"WITH {_MIX} SELECT event_id, {sql_rnd(f'{1 - OUTLIER!r}::DOUBLE * {sql_phi(chr(122) + chr(105))} + {OUTLIER}::DOUBLE * {sql_phi(chr(122) + chr(111))}')} AS pit FROM d",
)
def f16(t):
    return t.events.select("event_id", rnd(S.mixture_cdf(*_MIX_ARGS())).alias("pit"))


# Student-t quantiles with 5 degrees of freedom for 50/80/90/95 % intervals.
T5 = {50: 0.7266868438, 80: 1.4758840488, 90: 2.0150483727, 95: 2.5705818356}


@query(
    "f17_transfer_interval",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"{sql_rnd(f'l_quantity {s} {T5[v]!r}::DOUBLE * sqrt(l_tax * l_tax * 100 + 15.5769 ** 2)', 4)} AS {n}{v}"
        for v in T5
        for s, n in (("-", "lo"), ("+", "hi"))
    )
    + " FROM lineitem",
)
def f17(t):
    sd = F.sqrt(F.col("l_tax") * F.col("l_tax") * 100 + F.lit(15.5769**2))
    out = []
    for level in T5:
        lo, hi = S.central_interval(
            F.col("l_quantity"), sd, S.student_t_quantile(0.5 + level / 200, 5)
        )
        out += [rnd(lo, 4).alias(f"lo{level}"), rnd(hi, 4).alias(f"hi{level}")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *out)


@query(
    "f18_interval_scores",
    f"""SELECT event_id, {sql_rnd('(40 - 10) + 10 * greatest(10 - value, 0) + 10 * greatest(value - 40, 0)')} AS interval_score_80,
    {sql_rnd('(0.5 * abs(value - 22) + 0.1 * ((40 - 10) + 10 * greatest(10 - value, 0) + 10 * greatest(value - 40, 0)) + 0.025 * ((60 - 2) + 40 * greatest(2 - value, 0) + 40 * greatest(value - 60, 0))) / 2.5')} AS wis FROM events""",
)
def f18(t):
    v, lit = F.col("value"), F.lit
    pairs = {80: (lit(10.0), lit(40.0)), 95: (lit(2.0), lit(60.0))}
    return t.events.select(
        "event_id",
        rnd(S.interval_score(v, *pairs[80], 0.2)).alias("interval_score_80"),
        rnd(S.weighted_interval_score(v, lit(22.0), pairs)).alias("wis"),
    )


@query(
    "f19_coverage_flags",
    "SELECT event_id, value >= 10 AND value <= 40 AS covered, value < 10 AS below, value > 40 AS above FROM events",
)
def f19(t):
    v = F.col("value")
    inside = S.covered(v, F.lit(10.0), F.lit(40.0))
    return t.events.select("event_id", inside.alias("covered"), (v < 10).alias("below"), (v > 40).alias("above"))


@query(
    "f20_piecewise_linear",
    f"""SELECT event_id, {sql_rnd('CASE WHEN value <= 5 THEN 3 WHEN value <= 20 THEN 3 + (value - 5) * (1.0 - 3) / 15 WHEN value <= 80 THEN 1 + (value - 20) * (-2.0 - 1) / 60 ELSE -2 END')} AS rate FROM events""",
)
def f20(t):
    rate = C.piecewise_linear(F.col("value"), [(5, 3), (20, 1), (80, -2)])
    return t.events.select("event_id", rnd(rate).alias("rate"))


@query(
    "f21_global_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE l_linenumber + 6 END AS global_number,
      CASE WHEN l_linestatus = 'F' THEN '1-6' ELSE '7-12' END AS label FROM lineitem""",
)
def f21(t):
    side = F.when(F.col("l_linestatus") == "F", "R").otherwise("L")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        C.global_number(F.col("l_linenumber"), side).alias("global_number"),
        C.global_label(side).alias("label"),
    )


@query(
    "f22_json_list",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(to_json([l_linenumber, l_partkey, l_suppkey]) AS VARCHAR) AS cell, l_linenumber + l_partkey + l_suppkey AS total FROM lineitem""",
)
def f22(t):
    cell = F.to_json(F.array(F.col("l_linenumber").cast("bigint"), "l_partkey", "l_suppkey"))
    back = F.from_json("cell", "array<bigint>")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cell.alias("cell")).withColumn(
        "total", F.aggregate(back, F.lit(0).cast("bigint"), lambda a, x: a + x)
    )


@query(
    "f23_redaction",
    """SELECT page_id, sha256(regexp_replace(replace(replace(html, 'http://', 'link '), '</p>', '<br>'), '<title>.*?</title>', '<title>removed</title>', 'gs')) AS digest FROM pages""",
)
def f23(t):
    text = C.replace_all(F.col("html"), {"http://": "link ", "</p>": "<br>"})
    text = C.blank_elements(text, ["title"], {"title": "removed"})
    return t.pages.select("page_id", F.sha2(text, 256).alias("digest"))


# Examples of what a released text must not contain; a caller passes own patterns.
FORBIDDEN = {
    "mail address": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+[.][A-Za-z]+",
    "web address": r"https?://[A-Za-z0-9.-]+",
    "number with a country code": r"[+][0-9]{2}[ 0-9-]{8,}",
    "licence line": r"Licensed under [A-Za-z ]+",
}


@query(
    "f24_forbidden_patterns",
    " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS label, regexp_extract(text, '{p}') AS match FROM documents WHERE regexp_matches(text, '{p}')"
        for k, p in FORBIDDEN.items()
    ),
)
def f24(t):
    found = t.documents.select(
        "doc_id", F.explode(C.forbidden_matches(F.col("text"), FORBIDDEN)).alias("m")
    )
    return found.select("doc_id", "m.label", "m.match")
