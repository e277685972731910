"""Point-in-time feature programs, forecast labels and splits over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..operators.context import by_time
from .tables import EVENT_FIRST, EVENT_LAST, ORDER_CUTOFFS, rounded, stamped, table

_CUTS = ", ".join(f"(TIMESTAMP '{c}')" for c in ORDER_CUTOFFS)
_EVENT_CUTS = f"SELECT unnest(generate_series(TIMESTAMP '{EVENT_FIRST}', TIMESTAMP '{EVENT_LAST}', INTERVAL 7 DAY)) AS cutoff"
#: DuckDB macros as text: the scalar functions of the programs.
LOGS = lambda x, c: f"least(ln(1 + coalesce({x}, 0)) / ln({c} + 1.0::DOUBLE), 1.0::DOUBLE)"
DEC = lambda x, t: f"exp(-coalesce({x}, 9999)::DOUBLE / {t}.0::DOUBLE)"
CAP = lambda x, d, D: f"least(coalesce({x}, {D})::DOUBLE / {d}::DOUBLE, 1.0::DOUBLE)"
SH = lambda x, s: f"least(greatest(0.5::DOUBLE + coalesce({x}, 0)::DOUBLE / {s}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
RAT = lambda a, b, D: f"CASE WHEN coalesce({b}, 0) > 0 THEN coalesce({a}, 0)::DOUBLE / {b}::DOUBLE ELSE {D}::DOUBLE END"


def _spine(spark: SparkSession, sf: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    return H.spine_of(table(spark, sf, name), key, list(ORDER_CUTOFFS))


def pit_customer_churn_features(spark: SparkSession, sf: str) -> DataFrame:
    """Recency, frequency, spend, trend and cadence of each customer's orders before each cutoff."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    spine = _spine(spark, sf)
    seen = H.before(spine, orders, [("c_custkey", "o_custkey")], "o_orderdate")
    gap = F.col("days_ago") - F.lead("days_ago").over(Window.partitionBy("c_custkey", "cutoff").orderBy("o_orderdate", "o_orderkey"))
    d = F.col("days_ago")
    agg = seen.withColumn("gap", gap).groupBy("c_custkey", "cutoff").agg(
        F.count("*").alias("n"), F.min("days_ago").alias("last"), H.count_if(d <= 90).alias("n90"), H.count_if(d <= 365).alias("n365"),
        (H.sum_if("o_totalprice", d <= 180) - H.sum_if("o_totalprice", (d > 180) & (d <= 360))).alias("trend"),
        F.avg("gap").alias("avg_gap"), F.max("gap").alias("max_gap"), H.sum_if("o_totalprice", d <= 365).alias("spend"),
        F.count_distinct("o_orderpriority").alias("kinds"), F.avg(F.when(F.col("o_orderpriority") == "1-URGENT",
            1.0).otherwise(0.0)).alias("urgent"),
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = spine.join(agg, ["c_custkey", "cutoff"], "left").join(customer, "c_custkey", "left")
    return rounded(out.select(
        "c_custkey", "cutoff", S.decay("last", 180).alias("f_recency"), S.log_scaled("n90", 5).alias("f_n90"),
            S.log_scaled("n365", 20).alias("f_n365"), S.log_scaled("n", 50).alias("f_total"),
        S.centred("trend", 400000).alias("f_trend"), S.capped("avg_gap", 365, 365).alias("f_gap"),
        (F.least(F.greatest(S.num("last", 9999) / F.greatest(S.num("max_gap", 1), F.lit(1.0)), F.lit(0.0)),
            F.lit(3.0)) / 3).alias("f_overdue"),
        S.log_scaled("spend", 500000).alias("f_spend"), S.ratio("kinds", F.lit(5), 0).alias("f_kinds"),
            F.coalesce("urgent", F.lit(0.5)).alias("f_urgent"),
        S.flag(F.col("c_mktsegment") == "BUILDING").alias("f_building"), S.flag(F.col("n").isNull()).alias("f_new"),
    ))


PIT_CUSTOMER_SQL = f"""
WITH task AS (SELECT c_custkey, cutoff FROM customer, (VALUES {_CUTS}) c(cutoff)),
seen AS (SELECT c_custkey, cutoff, o_orderkey, o_orderdate, o_totalprice, o_orderpriority, date_diff('day', o_orderdate, cutoff) AS d
         FROM task JOIN orders ON o_custkey = c_custkey AND o_orderdate < cutoff),
gaps AS (SELECT *, d - lead(d) OVER (PARTITION BY c_custkey, cutoff ORDER BY o_orderdate, o_orderkey) AS gap FROM seen),
agg AS (SELECT c_custkey, cutoff, count(*) AS n, min(d) AS last, count(*) FILTER (WHERE d <= 90) AS n90, count(*) FILTER (WHERE d <= 365) AS n365,
  sum(o_totalprice) FILTER (WHERE d <= 180) - sum(o_totalprice) FILTER (WHERE d > 180 AND d <= 360) AS trend,
  avg(gap) AS avg_gap, max(gap) AS max_gap, sum(o_totalprice) FILTER (WHERE d <= 365) AS spend, count(DISTINCT o_orderpriority) AS kinds,
  avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent FROM gaps GROUP BY 1, 2)
SELECT task.c_custkey, task.cutoff, round({DEC('last', 180)}, 6) AS f_recency, round({LOGS('n90', 5)}, 6) AS f_n90, round({LOGS('n365', 20)}, 6) AS f_n365,
  round({LOGS('n', 50)}, 6) AS f_total, round({SH('trend', 400000)}, 6) AS f_trend, round({CAP('avg_gap', 365, 365)}, 6) AS f_gap,
  round(least(greatest(coalesce(last, 9999)::DOUBLE / greatest(coalesce(max_gap, 1)::DOUBLE, 1.0), 0.0), 3.0) / 3.0::DOUBLE, 6) AS f_overdue,
  round({LOGS('spend', 500000)}, 6) AS f_spend, round(coalesce(kinds, 0)::DOUBLE / 5.0::DOUBLE, 6) AS f_kinds, round(coalesce(urgent, 0.5)::DOUBLE, 6) AS f_urgent,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_building, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_new
FROM task LEFT JOIN agg USING (c_custkey, cutoff) LEFT JOIN customer c ON c.c_custkey = task.c_custkey
"""


def pit_part_sales_features(spark: SparkSession, sf: str) -> DataFrame:
    """Sales of each part before each cutoff, beside those of its brand."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    spine = _spine(spark, sf, "part", "p_partkey")
    d = F.col("days_ago")
    agg = H.before(spine, lines, [("p_partkey", "l_partkey")], "l_shipdate").groupBy("p_partkey", "cutoff").agg(
        H.sum_if("l_quantity", d <= 90).alias("q90"), H.sum_if("l_quantity", d <= 365).alias("q365"), F.sum("l_quantity").alias("q"),
        (H.sum_if("l_quantity", d <= 180) - H.sum_if("l_quantity", (d > 180) & (d <= 360))).alias("trend"), F.min("days_ago").alias("last"),
            F.max("days_ago").alias("age"),
        F.stddev_pop("l_quantity").alias("spread"), F.count_distinct(F.when(d <= 365, F.col("l_suppkey"))).alias("sellers"),
            F.avg("l_extendedprice").alias("price"),
    )
    brand = brand_before(spark, sf)
    out = spine.join(H.spread(agg), ["p_partkey", "cutoff"], "left").join(H.spread(part), "p_partkey", "left").join(brand, ["p_brand", "cutoff"], "left")
    return rounded(out.select(
        "p_partkey", "cutoff", S.log_scaled("q90", 100).alias("f_q90"), S.log_scaled("q365", 300).alias("f_q365"),
            S.log_scaled("q", 1000).alias("f_q"), S.centred("trend", 200).alias("f_trend"),
        S.decay("last", 100).alias("f_recency"), S.log_scaled("age", 3000).alias("f_age"), S.capped("spread", 20, 0).alias("f_spread"),
            S.log_scaled("sellers", 20).alias("f_sellers"),
        S.log_ratio("price", 12).alias("f_price"), F.least(S.ratio("q365",
            F.col("b365") / F.greatest(F.col("b_parts").cast("double"), F.lit(1.0)), 0), F.lit(3.0)).alias("f_vs_brand"),
            S.flag(F.col("q").isNull()).alias("f_never"),
    ))


def brand_before(spark: SparkSession, sf: str) -> DataFrame:
    """A brand's last year at each distinct cutoff: facts are first added up by brand and day, so the range join
    meets a few rows for each cutoff instead of every line."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    daily = lines.where(F.col("l_shipdate") < stamped(max(ORDER_CUTOFFS))).join(H.spread(part),
        F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_partkey",
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day")).agg(F.sum("l_quantity").alias("q"))
    cuts = F.array(*[stamped(c) for c in ORDER_CUTOFFS])
    met = daily.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: (F.col("day") < c) & (F.datediff(c, "day") <= 365))))
    return met.groupBy("p_brand", "cutoff").agg(F.sum("q").alias("b365"), F.count_distinct("l_partkey").alias("b_parts"))


def pit_brand_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(brand_before(spark, sf), 3)


BRAND_SQL = f"""
SELECT p_brand, cutoff, round(sum(l_quantity), 3) AS b365, count(DISTINCT l_partkey) AS b_parts
FROM (SELECT DISTINCT cutoff FROM (VALUES {_CUTS}) c(cutoff)) JOIN lineitem ON date_trunc('day', l_shipdate) < cutoff AND date_diff('day', l_shipdate, cutoff) <= 365
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
"""

PIT_PART_SQL = f"""
WITH task AS (SELECT p_partkey, p_brand, cutoff FROM part, (VALUES {_CUTS}) c(cutoff)),
seen AS (SELECT p_partkey, cutoff, l_suppkey, l_quantity, l_extendedprice, date_diff('day', l_shipdate, cutoff) AS d FROM task JOIN lineitem ON l_partkey = p_partkey AND l_shipdate < cutoff),
agg AS (SELECT p_partkey, cutoff, sum(l_quantity) FILTER (WHERE d <= 90) AS q90, sum(l_quantity) FILTER (WHERE d <= 365) AS q365, sum(l_quantity) AS q,
  sum(l_quantity) FILTER (WHERE d <= 180) - sum(l_quantity) FILTER (WHERE d > 180 AND d <= 360) AS trend, min(d) AS last, max(d) AS age, stddev_pop(l_quantity) AS spread,
  count(DISTINCT l_suppkey) FILTER (WHERE d <= 365) AS sellers, avg(l_extendedprice) AS price FROM seen GROUP BY 1, 2),
brand AS ({BRAND_SQL})
SELECT p_partkey, cutoff, round({LOGS('q90', 100)}, 6) AS f_q90, round({LOGS('q365', 300)}, 6) AS f_q365, round({LOGS('q', 1000)}, 6) AS f_q, round({SH('trend', 200)}, 6) AS f_trend,
  round({DEC('last', 100)}, 6) AS f_recency, round({LOGS('age', 3000)}, 6) AS f_age, round({CAP('spread', 20, 0)}, 6) AS f_spread, round({LOGS('sellers', 20)}, 6) AS f_sellers,
  round(least(ln(1 + coalesce(price, 0)) / 12.0::DOUBLE, 1.0::DOUBLE), 6) AS f_price,
  round(CASE WHEN b365 / greatest(b_parts::DOUBLE, 1.0) > 0 THEN least(coalesce(q365, 0) / (b365 / greatest(b_parts::DOUBLE, 1.0)), 3.0::DOUBLE) ELSE 0.0 END::DOUBLE, 6) AS f_vs_brand,
  CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_never
FROM task LEFT JOIN agg USING (p_partkey, cutoff) LEFT JOIN brand USING (p_brand, cutoff)
"""


def pit_user_engagement(spark: SparkSession, sf: str) -> DataFrame:
    """Activity of each user by kind of event before weekly cutoffs."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    spine = H.spine_between(events.select("user_id").distinct(), "user_id", EVENT_FIRST, EVENT_LAST, 7)
    facts = events.withColumnRenamed("user_id", "who")
    d, kind = F.col("days_ago"), F.col("event_type")
    agg = H.before(spine, facts, [("user_id", "who")], "ts").groupBy("user_id", "cutoff").agg(
        F.count("*").alias("n"), F.min("days_ago").alias("last"), F.min(F.when(kind == "purchase", d)).alias("last_buy"),
            H.count_if(d <= 3).alias("n3"), H.count_if(d <= 7).alias("n7"),
        H.count_if((kind == "purchase") & (d <= 14)).alias("buys"),
            F.try_divide(H.sum_if(F.round(F.col("value") * 100).cast("long"), kind == "view").cast("double"),
            H.count_if((kind == "view") & F.col("value").isNotNull()) * 100.0).alias("viewed"),
            F.max(F.when(kind == "purchase", 1).otherwise(0)).alias("bought"),
        F.count_distinct("event_type").alias("kinds"), F.max("days_ago").alias("age"),
    )
    out = spine.join(agg, ["user_id", "cutoff"], "left")
    return rounded(out.select(
        "user_id", "cutoff", F.exp(-F.least(S.num("last", 9999), S.num("last_buy", 9999)) / 6.0).alias("f_recent"),
            S.decay("last_buy", 9).alias("f_buy"), S.log_scaled("n3", 20).alias("f_n3"),
        S.log_scaled("n7", 50).alias("f_n7"), S.log_scaled("n", 200).alias("f_n"), S.ratio("buys", "n7", 0.5).alias("f_buy_rate"),
            S.capped("viewed", 97, 0).alias("f_viewed"),
        S.num("bought").alias("f_bought"), S.ratio("kinds", F.lit(5), 0).alias("f_kinds"),
            (F.coalesce(F.col("age") - F.col("last"), F.lit(0)) / F.nullif(F.col("n") - 1, F.lit(0))).cast("double").alias("f_cadence"),
            S.flag(F.col("n").isNull()).alias("f_new"),
    ))


PIT_USER_SQL = f"""
WITH task AS (SELECT user_id, cutoff FROM (SELECT DISTINCT user_id FROM events), ({_EVENT_CUTS})),
seen AS (SELECT t.user_id, cutoff, event_type, value, date_diff('day', ts, cutoff) AS d FROM task t JOIN events e ON e.user_id = t.user_id AND ts < cutoff),
agg AS (SELECT user_id, cutoff, count(*) AS n, min(d) AS last, min(d) FILTER (WHERE event_type = 'purchase') AS last_buy, count(*) FILTER (WHERE d <= 3) AS n3, count(*) FILTER (WHERE d <= 7) AS n7,
  count(*) FILTER (WHERE event_type = 'purchase' AND d <= 14) AS buys, (sum(round(value * 100)::BIGINT) FILTER (WHERE event_type = 'view'))::DOUBLE / ((count(value) FILTER (WHERE event_type = 'view')) * 100.0::DOUBLE) AS viewed, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought,
  count(DISTINCT event_type) AS kinds, max(d) AS age FROM seen GROUP BY 1, 2)
SELECT user_id, cutoff, round(exp(-least(coalesce(last, 9999), coalesce(last_buy, 9999))::DOUBLE / 6.0::DOUBLE), 6) AS f_recent, round({DEC('last_buy', 9)}, 6) AS f_buy,
  round({LOGS('n3', 20)}, 6) AS f_n3, round({LOGS('n7', 50)}, 6) AS f_n7, round({LOGS('n', 200)}, 6) AS f_n, round({RAT('buys', 'n7', 0.5)}, 6) AS f_buy_rate, round({CAP("viewed", 97, 0)}, 6) AS f_viewed,
  coalesce(bought, 0)::DOUBLE AS f_bought, round(coalesce(kinds, 0)::DOUBLE / 5.0::DOUBLE, 6) AS f_kinds, round(coalesce(age - last, 0)::DOUBLE / nullif(n - 1, 0), 6) AS f_cadence,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_new
FROM task LEFT JOIN agg USING (user_id, cutoff)
"""


def pit_supplier_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' lines, and the orders those lines belong to, each hop cut at the supplier's cutoff."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    spine = _spine(spark, sf, "supplier", "s_suppkey")
    one = H.before(spine, lines, [("s_suppkey", "l_suppkey")], "l_shipdate")
    first = one.groupBy("s_suppkey", "cutoff").agg(F.count("*").alias("lines"), H.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.min("days_ago").alias("last"))
    two = one.drop("days_ago").join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_orderdate") < F.col("cutoff")))
    second = two.groupBy("s_suppkey", "cutoff").agg(F.count_distinct("o_orderkey").alias("orders"),
        F.count_distinct("o_custkey").alias("buyers"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("filled"))
    out = spine.join(first, ["s_suppkey", "cutoff"], "left").join(second, ["s_suppkey", "cutoff"], "left")
    return rounded(out.select("s_suppkey", "cutoff", S.log_scaled("lines", 1000).alias("f_lines"),
        S.ratio("returned", "lines", 0.3).alias("f_returned"), S.decay("last", 30).alias("f_recency"),
        S.log_scaled("orders", 1000).alias("f_orders"), S.log_scaled("buyers", 1000).alias("f_buyers"),
        F.coalesce("filled", F.lit(0.5)).alias("f_filled")))


PIT_SUPPLIER_SQL = f"""
WITH task AS (SELECT s_suppkey, cutoff FROM supplier, (VALUES {_CUTS}) c(cutoff)),
one AS (SELECT s_suppkey, cutoff, l_orderkey, l_returnflag, date_diff('day', l_shipdate, cutoff) AS d FROM task JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate < cutoff),
first AS (SELECT s_suppkey, cutoff, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(d) AS last FROM one GROUP BY 1, 2),
second AS (SELECT s_suppkey, cutoff, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS buyers, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS filled
           FROM one JOIN orders ON l_orderkey = o_orderkey AND o_orderdate < cutoff GROUP BY 1, 2)
SELECT s_suppkey, cutoff, round({LOGS('lines', 1000)}, 6) AS f_lines, round({RAT('returned', 'lines', 0.3)}, 6) AS f_returned, round({DEC('last', 30)}, 6) AS f_recency,
  round({LOGS('orders', 1000)}, 6) AS f_orders, round({LOGS('buyers', 1000)}, 6) AS f_buyers, round(coalesce(filled, 0.5)::DOUBLE, 6) AS f_filled
FROM task LEFT JOIN first USING (s_suppkey, cutoff) LEFT JOIN second USING (s_suppkey, cutoff)
"""


def pit_peer_history(spark: SparkSession, sf: str) -> DataFrame:
    """What a customer's peers (same nation and segment, not the customer) ordered before the cutoff.

    Peers' orders are added up for each group first and the customer's own share is taken off, so the self-join
    of a group's members is never formed.
    """
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    spine = _spine(spark, sf)
    own = H.before(spine, orders, [("c_custkey", "o_custkey")], "o_orderdate").groupBy("c_custkey", "cutoff").agg(F.count("*").alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    full = spine.join(own, ["c_custkey", "cutoff"], "left").join(customer, "c_custkey").fillna(0, ["n", "v"])
    peers = full.groupBy("c_nationkey", "c_mktsegment", "cutoff").agg(F.count("*").alias("people"), F.sum("n").alias("all_n"),
        F.sum("v").alias("all_v"), H.count_if(F.col("n") > 0).alias("active"))
    out = full.join(peers, ["c_nationkey", "c_mktsegment", "cutoff"])
    return rounded(out.select(
        "c_custkey", "cutoff", (F.col("people") - 1).alias("peers"),
            (F.col("active") - F.when(F.col("n") > 0, 1).otherwise(0)).alias("peers_active"),
            (F.col("all_n") - F.col("n")).alias("peer_orders"),
        F.when(F.col("all_n") > F.col("n"), (F.col("all_v") - F.col("v")) / (F.col("all_n") - F.col("n"))).alias("peer_value"),
    ), 4)


PIT_PEER_SQL = f"""
WITH task AS (SELECT c_custkey, c_nationkey, c_mktsegment, cutoff FROM customer, (VALUES {_CUTS}) c(cutoff)),
peer AS (SELECT t.c_custkey, t.cutoff, p.c_custkey AS other FROM task t JOIN customer p ON p.c_nationkey = t.c_nationkey AND p.c_mktsegment = t.c_mktsegment AND p.c_custkey <> t.c_custkey),
hist AS (SELECT o_custkey, cutoff, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT) AS v FROM orders JOIN (VALUES {_CUTS}) c(cutoff) ON o_orderdate < cutoff GROUP BY 1, 2)
SELECT task.c_custkey, task.cutoff, count(other)::BIGINT AS peers, count(n)::BIGINT AS peers_active, coalesce(sum(n), 0)::BIGINT AS peer_orders, round(sum(v)::DOUBLE / sum(n)::DOUBLE, 4) AS peer_value
FROM task LEFT JOIN peer USING (c_custkey, cutoff) LEFT JOIN hist ON hist.o_custkey = other AND hist.cutoff = task.cutoff GROUP BY 1, 2
"""


def pit_first_last_order(spark: SparkSession, sf: str) -> DataFrame:
    """FIRST(... ORDER BY ...) in both directions, and a join on what it found: the latest order's part suppliers' nation."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    spine = _spine(spark, sf)
    seen = H.before(spine, orders, [("c_custkey", "o_custkey")], "o_orderdate")
    agg = seen.groupBy("c_custkey", "cutoff").agg(
        H.first_by("o_orderpriority", "o_orderdate", "o_orderkey").alias("first_priority"),
            F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"),
            F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"),
    )
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("last_order")).agg(F.count("*").alias("last_lines"),
        F.max("l_quantity").alias("last_most"))
    return agg.join(lines, "last_order", "left")


FIRST_LAST_SQL = f"""
WITH seen AS (SELECT c_custkey, cutoff, o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM customer, (VALUES {_CUTS}) c(cutoff), orders WHERE o_custkey = c_custkey AND o_orderdate < cutoff),
agg AS (SELECT c_custkey, cutoff, first(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS first_priority, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_order, first(o_totalprice ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_price FROM seen GROUP BY 1, 2)
SELECT agg.*, last_lines, last_most FROM agg LEFT JOIN (SELECT l_orderkey AS last_order, count(*) AS last_lines, max(l_quantity) AS last_most FROM lineitem GROUP BY 1) USING (last_order)
"""


def asof_latest_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's latest order of its user before it, by one pass over both time lines."""
    events = table(spark, sf, "events").select(F.col("user_id"), F.col("ts").alias("cutoff")).distinct()
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return H.as_of(events, orders, ("user_id", "o_custkey"), "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey")


ASOF_SQL = """
SELECT user_id, cutoff, as_of_time, o_orderkey, o_totalprice FROM (
  SELECT e.user_id, e.cutoff, o_orderdate AS as_of_time, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY e.user_id, e.cutoff ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k
  FROM (SELECT DISTINCT user_id, ts AS cutoff FROM events) e LEFT JOIN orders ON o_custkey = e.user_id AND o_orderdate < e.cutoff) WHERE k = 1
"""


def gap_lead_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between consecutive orders: a window inside, aggregates outside."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = table(spark, sf, "orders").select("o_custkey", S.days_between(F.lead("o_orderdate").over(w), F.col("o_orderdate")).alias("gap"))
    return rounded(gaps.where("gap IS NOT NULL").groupBy("o_custkey").agg(F.max("gap").alias("longest"), F.avg("gap").alias("mean_gap"),
        F.count("*").alias("gaps")))


GAP_SQL = """
SELECT o_custkey, max(gap) AS longest, round(avg(gap), 6) AS mean_gap, count(*) AS gaps
FROM (SELECT o_custkey, date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS gap FROM orders) WHERE gap IS NOT NULL GROUP BY 1
"""


def category_median_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "part").where("p_retailprice > 0").groupBy("p_brand")
        .agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice)").alias("median_price"), F.count("*").alias("n")))


MEDIAN_SQL = (
    "SELECT p_brand, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice), 6) AS median_price, "
    "count(*) AS n FROM part WHERE p_retailprice > 0 GROUP BY 1"
)


def order_status_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of filtered sums, conditional rates, flags, null-safe ratios and cadence by customer."""
    orders = table(spark, sf, "orders")
    d, p = S.days_between(stamped(ORDER_CUTOFFS[-1]), "o_orderdate"), F.col("o_totalprice")
    past = orders.where(F.col("o_orderdate") < stamped(ORDER_CUTOFFS[-1])).withColumn("d", d)
    d = F.col("d")
    return rounded(past.groupBy("o_custkey").agg(
        (H.sum_if(p, d <= 365) - H.sum_if(p, (d > 365) & (d <= 730))).alias("trend"),
            F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)).alias("filled_rate"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("long").alias("any_urgent"),
            (H.count_if(F.col("o_orderstatus") == "F").cast("double") / F.nullif(H.count_if(F.col("o_orderstatus") == "O"),
            F.lit(0))).alias("f_per_o"),
        F.when(F.count("*") > 1, (F.max(d) - F.min(d)).cast("double") / (F.count("*") - 1)).alias("cadence"),
            F.min(F.when(F.col("o_orderstatus") == "P", p)).alias("least_pending"),
    ), 4)


TREND_SQL = f"""
SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE d <= 365) - sum(o_totalprice) FILTER (WHERE d > 365 AND d <= 730), 4) AS trend,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 ELSE NULL END)::DOUBLE, 4) AS filled_rate, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS any_urgent,
  round((count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE / nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0), 4) AS f_per_o,
  round(CASE WHEN count(*) > 1 THEN (max(d) - min(d))::DOUBLE / (count(*) - 1) END, 4) AS cadence, round(min(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS least_pending
FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '{ORDER_CUTOFFS[-1]}') AS d FROM orders WHERE o_orderdate < TIMESTAMP '{ORDER_CUTOFFS[-1]}') GROUP BY 1
"""


def churn_labels(spark: SparkSession, sf: str, days: int = 180) -> DataFrame:
    """Eligible customers (some order before the cutoff) and whether none follows within the window."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    spine = _spine(spark, sf)
    eligible = spine.join(H.spread(orders), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderdate") < F.col("cutoff")), "left_semi")
    return H.within(eligible, orders, [("c_custkey", "o_custkey")], "o_orderdate", days).groupBy("c_custkey",
        "cutoff").agg((F.count("o_custkey") == 0).alias("churn"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spend"))


def label_customer_churn(spark: SparkSession, sf: str) -> DataFrame:
    return churn_labels(spark, sf).select("c_custkey", "cutoff", "churn")


def label_customer_spend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(churn_labels(spark, sf).select("c_custkey", "cutoff", "spend"), 2)


_LABELS = f"""
SELECT c_custkey, cutoff, count(o.o_custkey) = 0 AS churn, round(coalesce(sum(o.o_totalprice), 0), 2) AS spend
FROM (SELECT DISTINCT c_custkey, cutoff FROM customer, (VALUES {_CUTS}) c(cutoff), orders WHERE o_custkey = c_custkey AND o_orderdate < cutoff) s
LEFT JOIN orders o ON o.o_custkey = s.c_custkey AND o.o_orderdate > cutoff AND o.o_orderdate <= cutoff + INTERVAL 180 DAY GROUP BY 1, 2
"""


def split_by_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The last cutoff is the test split, the one before it validates, the rest trains."""
    labels = churn_labels(spark, sf)
    order = labels.select("cutoff").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("cutoff"))))
    split = F.when(F.col("k") == 1, "test").when(F.col("k") == 2, "val").otherwise("train")
    return labels.join(F.broadcast(order), "cutoff").select("c_custkey", "cutoff", split.alias("split"))


SPLIT_SQL = f"""SELECT c_custkey, cutoff, CASE dense_rank() OVER (ORDER BY cutoff DESC) WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM ({_LABELS})"""


def split_positional(spark: SparkSession, sf: str) -> DataFrame:
    """80/10/10 by time. Places come from counts by time and a rank inside it, so no task sorts the table or a day of it."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    total = orders.where("o_orderdate IS NOT NULL").agg(F.count("*").alias("total"))
    placed = by_time(orders, "o_orderdate", "o_orderkey").crossJoin(F.broadcast(total))  # one row
    early, late = [F.floor(F.col("total") * share) for share in (0.8, 0.9)]
    split = F.when(F.col("place") < early, "train").when(F.col("place") < late, "val").otherwise("test")
    return placed.select("o_orderkey", split.alias("split"))


POSITIONAL_SQL = """
SELECT o_orderkey, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey % 64, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
"""


def features_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return H.dedup_first(lines, ["l_orderkey", "l_linenumber"])


DEDUP_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1
"""


def features_zscored(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", "c_acctbal",
        F.try_divide(F.lit(1000.0), F.col("c_custkey").cast("double")).alias("inverse"), F.lit(3.0).alias("constant"))
    return rounded(H.zscored(raw, ["c_acctbal", "inverse", "constant"]), 5)


ZSCORE_SQL = """
WITH f AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey = 0 THEN 0.0 ELSE 1000.0::DOUBLE / c_custkey END AS inverse, 3.0::DOUBLE AS constant FROM customer),
s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(inverse) AS mi, stddev_pop(inverse) AS si FROM f)
SELECT c_custkey, round((c_acctbal - ma) / CASE WHEN sa < 1e-8 THEN 1 ELSE sa END, 5) AS c_acctbal, round((inverse - mi) / CASE WHEN si < 1e-8 THEN 1 ELSE si END, 5) AS inverse, round(constant - 3.0, 5)::DOUBLE AS constant FROM f, s
"""

QUERIES = {
    "pit_customer_churn_features": (pit_customer_churn_features, PIT_CUSTOMER_SQL),
    "pit_part_sales_features": (pit_part_sales_features, PIT_PART_SQL),
    "pit_user_engagement": (pit_user_engagement, PIT_USER_SQL),
    "pit_supplier_two_hop": (pit_supplier_two_hop, PIT_SUPPLIER_SQL),
    "pit_peer_history": (pit_peer_history, PIT_PEER_SQL),
    "pit_brand_cutoff": (pit_brand_cutoff, BRAND_SQL),
    "pit_first_last_order": (pit_first_last_order, FIRST_LAST_SQL),
    "asof_latest_order": (asof_latest_order, ASOF_SQL),
    "gap_lead_stats": (gap_lead_stats, GAP_SQL),
    "category_median_price": (category_median_price, MEDIAN_SQL),
    "order_status_trend": (order_status_trend, TREND_SQL),
    "label_customer_churn": (label_customer_churn, f"SELECT c_custkey, cutoff, churn FROM ({_LABELS})"),
    "label_customer_spend": (label_customer_spend, f"SELECT c_custkey, cutoff, spend FROM ({_LABELS})"),
    "split_by_cutoff": (split_by_cutoff, SPLIT_SQL),
    "split_positional": (split_positional, POSITIONAL_SQL),
    "features_dedup": (features_dedup, DEDUP_SQL),
    "features_zscored": (features_zscored, ZSCORE_SQL),
}
