"""The thirteen feature programs as queries: each domain's tables are views over the star schema and the events.

A view is one text for both engines; {orders} and the like stand for the supplied tables. The DuckDB texts state each
program on its own: past(...) joins the label rows with earlier facts, the rest adds up and scales.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from . import programs as P
from .features import _CUTS, _EVENT_CUTS, CAP, DEC, LOGS, RAT, SH
from .tables import EVENT_FIRST, EVENT_LAST, ORDER_CUTOFFS, rounded, table

_SUPPLIED = ("customer", "events", "lineitem", "orders", "part", "supplier")

VIEWS = {
    "racing": {
        "results": (
            "SELECT o_custkey AS driverId, o_orderkey AS raceId, o_orderkey % 10 AS constructorId, 1 + o_orderkey % 20 AS "
            "positionOrder, o_orderkey % 23 AS grid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS statusId, "
            "o_orderdate AS date FROM {orders}"
        ),
        "qualifying": (
            "SELECT o_custkey AS driverId, 1 + (o_orderkey * 7) % 22 AS position, o_orderdate + INTERVAL 1 DAY AS date "
            "FROM {orders}"
        ),
        "constructor_standings": (
            "SELECT o_orderkey % 10 AS constructorId, 1 + (o_orderkey * 3) % 11 AS position, o_orderdate AS date FROM "
            "{orders}"
        ),
    },
    "trials": {
        "studies": (
            "SELECT c_custkey AS nct_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Phase 3' WHEN 'MACHINERY' THEN 'Phase 4' "
            "WHEN 'AUTOMOBILE' THEN 'Phase 2/Phase 3' ELSE 'Phase 1' END AS phase, CAST(floor(abs(c_acctbal)) AS BIGINT) "
            "AS enrollment, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS has_dmc, first_at AS start_date, CASE "
            "WHEN c_custkey % 3 = 0 THEN 'Other' ELSE 'Interventional' END AS study_type FROM {customer} LEFT JOIN (SELECT "
            "o_custkey, min(o_orderdate) AS first_at FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey"
        ),
        "designs": (
            "SELECT o_custkey AS nct_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Single' WHEN '2-HIGH' THEN 'Double' "
            "WHEN '3-MEDIUM' THEN 'Triple' WHEN '5-LOW' THEN 'Quadruple' END AS masking, o_orderdate AS date FROM {orders}"
        ),
        "facilities_studies": "SELECT o_orderkey % 300 AS facility_id, o_custkey AS nct_id, o_orderdate AS date FROM {orders}",
        "sponsors_studies": "SELECT (o_orderkey * 11) % 2003 AS sponsor_id, o_custkey AS nct_id, o_orderdate AS date FROM {orders}",
        "conditions_studies": (
            "SELECT o_custkey % 157 AS condition_id, o_custkey AS nct_id, min(o_orderdate) AS date FROM {orders} GROUP BY "
            "o_custkey"
        ),
        "sponsors": (
            "SELECT DISTINCT (o_orderkey * 11) % 2003 AS sponsor_id, CASE WHEN (o_orderkey * 11) % 2003 % 4 = 0 THEN "
            "'Industry' ELSE 'Other' END AS agency_class FROM {orders}"
        ),
        "outcome_analyses": (
            "SELECT o_custkey AS nct_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) / 64 "
            "END AS p_value, o_orderdate + INTERVAL 2 DAY AS date FROM {orders}"
        ),
    },
    "ads": {
        "AdsInfo": "SELECT p_partkey AS AdID, p_size % 10 AS CategoryID, p_retailprice AS Price FROM {part}",
        "SearchStream": (
            "SELECT event_id - event_id % 3 AS SearchID, (event_id * 7) % 500 AS AdID, ts AS SearchDate, CASE WHEN "
            "event_type = 'click' THEN 1 ELSE 0 END AS IsClick, 1 + event_id % 9 AS Position, CAST(event_id % 64 AS "
            "DOUBLE) / 128 AS HistCTR FROM {events}"
        ),
        "VisitStream": "SELECT user_id AS UserID, (event_id * 3) % 500 AS AdID, ts AS ViewDate FROM {events}",
        "SearchInfo": "SELECT event_id AS SearchID, user_id AS UserID, ts AS SearchDate, event_id % 2 AS IsUserLoggedOn FROM {events}",
    },
    "retail": {
        "transactions": (
            "SELECT o_orderdate AS t_dat, o_custkey AS customer_id, o_orderkey % 400 AS article_id, o_totalprice / 131072 "
            "AS price, 1 + o_orderkey % 2 AS sales_channel_id FROM {orders}"
        ),
        "customer": (
            "SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey % 97 AS DOUBLE) END AS age, "
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'ACTIVE' WHEN 'MACHINERY' THEN 'PRE-CREATE' END AS club_member_status "
            "FROM {customer}"
        ),
        "article": "SELECT p_partkey AS article_id, p_brand AS product_group_name FROM {part}",
    },
    "forum": {
        "users": "SELECT o_custkey AS Id, min(o_orderdate) AS CreationDate FROM {orders} GROUP BY o_custkey",
        "posts": (
            "SELECT o_orderkey AS Id, o_custkey AS OwnerUserId, 1 + o_orderkey % 2 AS PostTypeId, o_orderkey - o_orderkey "
            "% 4 AS ParentId, o_orderdate AS CreationDate FROM {orders}"
        ),
        "comments": (
            "SELECT (o_orderkey * 5) % 4001 AS PostId, o_custkey AS UserId, o_orderdate + INTERVAL 3 DAY AS CreationDate "
            "FROM {orders}"
        ),
        "votes": (
            "SELECT l_suppkey AS UserId, l_orderkey AS PostId, 1 + l_linenumber % 3 AS VoteTypeId, l_shipdate AS "
            "CreationDate FROM {lineitem}"
        ),
        "badges": "SELECT o_custkey AS UserId, 1 + o_orderkey % 3 AS Class, o_orderdate + INTERVAL 9 DAY AS Date FROM {orders}",
        "postHistory": "SELECT l_orderkey AS PostId, l_partkey AS UserId, l_shipdate AS CreationDate FROM {lineitem}",
    },
    "reviews": {
        "review": (
            "SELECT l_shipdate AS review_time, l_suppkey AS customer_id, l_partkey AS product_id, CAST(1 + l_orderkey % 5 "
            "AS DOUBLE) AS rating, l_quantity > 25 AS verified FROM {lineitem}"
        ),
        "product": (
            "SELECT p_partkey AS product_id, p_brand AS category, CASE WHEN p_partkey % 10 > 0 THEN p_retailprice ELSE "
            "CAST(0 AS DOUBLE) END AS price FROM {part}"
        ),
    },
    "invitations": {
        "event_attendees": (
            "SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' WHEN 2 THEN 'no' ELSE 'invited' END "
            "AS status, ts AS start_time FROM {events}"
        ),
        "event_interest": (
            "SELECT user_id AS usr, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS invited, CASE WHEN event_id % 4 = 0 "
            "THEN 1 ELSE 0 END AS interested, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS not_interested, ts AS "
            "timestamp FROM {events}"
        ),
        "user_friends": "SELECT o_custkey AS usr, o_orderkey % 1000 AS friend FROM {orders}",
        "users": "SELECT user_id, min(ts) AS joinedAt FROM {events} GROUP BY user_id",
    },
}

#: Program to its domain, function, and the supplied table and key whose rows are its entities; events have other cutoffs.
SPINES: dict[str, tuple[str, Callable, str, str]] = {
    "racing_driver": ("racing", P.racing_driver, "customer", "c_custkey"),
    "trial_study": ("trials", P.trial_study, "customer", "c_custkey"),
    "trial_site": ("trials", P.trial_site, "supplier", "s_suppkey"),
    "ads_ad": ("ads", P.ads_ad, "part", "p_partkey"),
    "ads_user": ("ads", P.ads_user, "events", "user_id"),
    "retail_customer": ("retail", P.retail_customer, "customer", "c_custkey"),
    "retail_article": ("retail", P.retail_article, "part", "p_partkey"),
    "forum_user": ("forum", P.forum_user, "customer", "c_custkey"),
    "forum_post": ("forum", P.forum_post, "orders", "o_orderkey"),
    "forum_badge": ("forum", P.forum_badge, "customer", "c_custkey"),
    "reviews_customer": ("reviews", P.reviews_customer, "supplier", "s_suppkey"),
    "reviews_product": ("reviews", P.reviews_product, "part", "p_partkey"),
    "invited_user": ("invitations", P.invited_user, "events", "user_id"),
}
_EVENTS = ("ads", "invitations")


def database(spark: SparkSession, sf: str, domain: str) -> dict[str, DataFrame]:
    """A domain's tables by name."""
    out = {}
    for name, text in VIEWS[domain].items():
        used = {t: table(spark, sf, t) for t in _SUPPLIED if "{" + t + "}" in text}
        out[name] = spark.sql(text, **used).withColumnsRenamed({"usr": "user"})
    return out


def label_rows(spark: SparkSession, sf: str, program: str) -> DataFrame:
    """(who, cutoff): every entity at every cutoff."""
    domain, _, name, key = SPINES[program]
    who = table(spark, sf, name).select(F.col(key).alias("who"))
    if domain in _EVENTS:
        return H.spine_between(who.distinct() if name == "events" else who, "who", EVENT_FIRST, EVENT_LAST, 7)
    return H.spine_of(who, "who", list(ORDER_CUTOFFS))


def _query(program: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        domain, features, *_ = SPINES[program]
        return rounded(features(label_rows(spark, sf, program), database(spark, sf, domain)))

    run.__doc__ = f"The {program} program over all label rows."
    return run


# DuckDB texts.
LOGK = lambda x, k: f"least(ln(1 + coalesce({x}, 0)) / {k}::DOUBLE, 1.0::DOUBLE)"
DECD = lambda x, t, d: f"exp(-coalesce({x}, {d})::DOUBLE / {t}::DOUBLE)"
FLAG = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
NUM = lambda x, d=0: f"coalesce({x}, {d})::DOUBLE"
MEAN = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
TOP = lambda x: f"least({x}, 1.0::DOUBLE)"


def past(facts: str, key: str, time: str, columns: str = "f.*", task: str = "task") -> str:
    """Label rows with earlier facts; d is the calendar days between."""
    return (
        f"SELECT t.who, t.cutoff, date_diff('day', f.{time}, t.cutoff) AS d, {columns} FROM {task} t JOIN {facts} f ON "
        f"f.{key} = t.who AND f.{time} < t.cutoff"
    )


def _text(program: str, ctes: dict[str, str], features: dict[str, str], source: str) -> str:
    """A whole DuckDB text: the domain's views, the label rows, the program's own steps, its rounded features."""
    domain, _, name, key = SPINES[program]
    views = [(
        f"{n} AS "
        f"({re.sub('[{}]', '', text).replace(' customer ', ' main.customer ').replace('FROM customer', 'FROM main.customer')})"
    ) for n, text in VIEWS[domain].items()]
    cuts = f"({_EVENT_CUTS})" if domain in _EVENTS else f"(VALUES {_CUTS})"
    task = f"task AS (SELECT DISTINCT {key} AS who, cutoff FROM main.{name}, {cuts} c(cutoff))"
    steps = [*views, task, *(f"{n} AS ({text})" for n, text in ctes.items())]
    shown = ", ".join(f"round({x}, 6) AS {n}" for n, x in features.items())
    return f"WITH {', '.join(steps)} SELECT task.who, task.cutoff, {shown} FROM task {source}"


def _left(*ctes: str) -> str:
    return " ".join(f"LEFT JOIN {c} USING (who, cutoff)" for c in ctes)


_PEERS = lambda links, key: (
    f"SELECT a.who, a.cutoff, avg(p_value) AS p, count(DISTINCT b.nct_id) AS n, count(*) FILTER (WHERE p_value < "
    f"0.05) AS hits FROM ({past(links, 'nct_id', 'date', f'f.{key}')}) a JOIN {links} b ON b.{key} = a.{key} AND "
    f"b.nct_id <> a.who AND b.date < a.cutoff LEFT JOIN outcome_analyses o ON o.nct_id = b.nct_id AND o.date < "
    f"a.cutoff GROUP BY 1, 2"
)
_FORUM = {
    "own": (
        f"SELECT who, cutoff, min(d) AS last_post, count(*) FILTER (WHERE d <= 90) AS posts90, count(*) FILTER (WHERE d "
        f"<= 30) AS posts30, count(*) AS posts, count(*) FILTER (WHERE PostTypeId = 2) AS answers FROM "
        f"({past('posts', 'OwnerUserId', 'CreationDate')}) GROUP BY 1, 2"
    ),
    "talk": (
        f"SELECT who, cutoff, min(d) AS last_comment, count(*) FILTER (WHERE d <= 90) AS comments90 FROM "
        f"({past('comments', 'UserId', 'CreationDate')}) GROUP BY 1, 2"
    ),
    "voted": (
        f"SELECT who, cutoff, min(d) AS last_vote, count(*) FILTER (WHERE d <= 90) AS votes90 FROM "
        f"({past('votes', 'UserId', 'CreationDate')}) GROUP BY 1, 2"
    ),
    "edits": (
        f"SELECT who, cutoff, count(*) FILTER (WHERE d <= 90) AS edits90 FROM "
        f"({past('postHistory', 'UserId', 'CreationDate')}) GROUP BY 1, 2"
    ),
    "got": (
        f"SELECT p.who, p.cutoff, count(*) AS received FROM ({past('posts', 'OwnerUserId', 'CreationDate')}) p JOIN "
        f"votes v ON v.PostId = p.Id AND v.VoteTypeId = 2 AND v.CreationDate < p.cutoff GROUP BY 1, 2"
    ),
    "medals": (
        f"SELECT who, cutoff, count(*) AS badges, count(*) FILTER (WHERE d <= 90) AS badges90, count(*) FILTER (WHERE "
        f"Class = 1) AS gold FROM ({past('badges', 'UserId', 'Date')}) GROUP BY 1, 2"
    ),
    "aged": "SELECT who, cutoff, greatest(date_diff('day', u.CreationDate, cutoff), 0) AS age FROM task JOIN users u ON u.Id = who",
}
_FORUM_FROM = _left("own", "talk", "voted", "edits", "got", "medals", "aged")
_NEAR = lambda *days: "exp(-least(" + ", ".join(f"coalesce({d}, 9999)" for d in days) + ")::DOUBLE / 65)"
_SUMS = lambda *xs: " + ".join(f"coalesce({x}, 0)" for x in xs)
_REVIEWED = lambda key: (
    f"SELECT r.*, p.price, p.category FROM ({past('review', key, 'review_time')}) r LEFT JOIN product p USING "
    f"(product_id)"
)
_LATE, _ACTIVE = "phase IN ('Phase 3', 'Phase 4')", "study_type = 'Interventional'"

TEXTS = {
    "racing_driver": ({
        "own": (
            f"SELECT who, cutoff, count(*) AS n, count(*) FILTER (WHERE d <= 365) AS n1, avg(positionOrder) FILTER (WHERE d "
            f"<= 365) AS finish, avg(grid) FILTER (WHERE d <= 365 AND grid > 0) AS start, count(*) FILTER (WHERE "
            f"positionOrder <= 3) AS podia, count(*) FILTER (WHERE positionOrder <= 3 AND d <= 365) AS podia1, count(*) "
            f"FILTER (WHERE statusId <> 1) AS out, count(*) FILTER (WHERE statusId <> 1 AND d <= 365) AS out1, "
            f"first(constructorId ORDER BY d, raceId) AS team, first(positionOrder ORDER BY d, raceId) AS last, "
            f"first((statusId <> 1)::INTEGER ORDER BY d, raceId) AS last_out FROM ({past('results', 'driverId', 'date')}) "
            f"GROUP BY 1, 2"
        ),
        "quali": f"SELECT who, cutoff, avg(position) AS place FROM ({past('qualifying', 'driverId', 'date')}) WHERE d <= 365 GROUP BY 1, 2",
        "teams": "SELECT DISTINCT team AS who, cutoff FROM own",
        "standing": (
            f"SELECT who AS team, cutoff, first(position ORDER BY d, position) AS standing FROM "
            f"({past('constructor_standings', 'constructorId', 'date', task='teams')}) GROUP BY 1, 2"
        ),
        "pace": (
            f"SELECT who AS team, cutoff, avg(positionOrder) FILTER (WHERE d <= 365) AS pace FROM "
            f"({past('results', 'constructorId', 'date', task='teams')}) GROUP BY 1, 2"
        ),
    }, {
        "finish": CAP("finish", 20, 13), "start": CAP("start", 20, 13), "podium_rate": RAT("podia", "n", 0),
            "podium_rate_year": RAT("podia1", "n1", 0), "out_rate": RAT("out", "n", 0.5), "out_rate_year": RAT("out1", "n1", 0.5),
        "last_finish": CAP("last", 20, 13), "last_out": NUM("last_out"), "quali": CAP("place", 20, 13), "standing": CAP("standing", 10, 6),
            "team_finish": CAP("pace", 20, 13), "against_team": SH("coalesce(finish, 13) - coalesce(pace, 13)", 20),
    }, _left("own", "quali") + " LEFT JOIN standing USING (team, cutoff) LEFT JOIN pace USING (team, cutoff)"),
    "trial_study": ({
        "design": f"SELECT who, cutoff, min(masking) AS masking FROM ({past('designs', 'nct_id', 'date')}) GROUP BY 1, 2",
        "places": (
            f"SELECT who, cutoff, count(DISTINCT facility_id) AS sites FROM "
            f"({past('facilities_studies', 'nct_id', 'date')}) GROUP BY 1, 2"
        ),
        "sp": _PEERS("sponsors_studies", "sponsor_id"), "co": _PEERS("conditions_studies", "condition_id"),
    }, {
        "sponsor_p": NUM("sp.p", 0.5), "sponsor_studies": TOP("ln(1 + coalesce(sp.n, 0)) / ln(500::DOUBLE)"),
            "condition_p": NUM("co.p", 0.5), "condition_hits": TOP(RAT("co.hits", "co.n", 0.3)), "enrolled": LOGK("enrollment", 10.8),
        "recency": DECD("date_diff('day', start_date, task.cutoff)", 730, 0),
            "late": FLAG("phase IN ('Phase 3', 'Phase 4', 'Phase 2/Phase 3')"), "monitored": FLAG("has_dmc = 'Yes'"), "masking": (
            "CASE masking WHEN 'Single' THEN 0.25::DOUBLE WHEN 'Double' THEN 0.5::DOUBLE WHEN 'Triple' THEN 0.75::DOUBLE "
            "WHEN 'Quadruple' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        ), "sites": LOGK("sites", 6.9),
    }, "LEFT JOIN studies ON nct_id = task.who " + _left("design", "places", "sp", "co")),
    "trial_site": ({
        "met": past("facilities_studies", "facility_id", "date", "f.nct_id"),
        "counts": (
            "SELECT who, cutoff, count(DISTINCT nct_id) AS n, count(DISTINCT nct_id) FILTER (WHERE d <= 365) AS n1 FROM "
            "met GROUP BY 1, 2"
        ),
        "kinds": f"SELECT who, cutoff, {MEAN(_LATE)} AS late, {MEAN(_ACTIVE)} AS active FROM met JOIN studies USING (nct_id) GROUP BY 1, 2",
        "found": (
            "SELECT who, cutoff, count(*) FILTER (WHERE p_value < 0.05) AS hits, count(*) AS analyses FROM met JOIN "
            "outcome_analyses o USING (nct_id) WHERE o.date < cutoff GROUP BY 1, 2"
        ),
        "paid": (
            "SELECT who, cutoff, max((agency_class = 'Industry')::INTEGER) AS industry FROM met JOIN sponsors_studies s "
            "USING (nct_id) JOIN sponsors USING (sponsor_id) WHERE s.date < cutoff GROUP BY 1, 2"
        ),
    }, {
        "hit_rate": RAT("hits", "analyses", 0.44), "studies": LOGK("n", 6.2), "recent": RAT("n1", "n", 0), "late": NUM("late"),
            "interventional": NUM("active"), "industry": NUM("industry"), "has_outcome": FLAG("analyses IS NOT NULL"),
            "is_new": FLAG("n IS NULL"),
    }, _left("counts", "kinds", "found", "paid")),
    "ads_ad": ({
        "seen": (
            f"SELECT who, cutoff, count(*) AS n, count(*) FILTER (WHERE d <= 3) AS n3, sum(IsClick) AS clicks, sum(IsClick) "
            f"FILTER (WHERE d <= 3) AS clicks3, avg(Position) AS place, avg(HistCTR) AS history FROM "
            f"({past('SearchStream', 'AdID', 'SearchDate')}) GROUP BY 1, 2"
        ),
        "visited": f"SELECT who, cutoff, count(*) AS visits FROM ({past('VisitStream', 'AdID', 'ViewDate')}) GROUP BY 1, 2",
        "rates": (
            "SELECT CategoryID, cutoff, avg(IsClick) AS category_rate FROM (SELECT DISTINCT cutoff FROM task) JOIN "
            "SearchStream ON SearchDate < cutoff JOIN AdsInfo USING (AdID) GROUP BY 1, 2"
        ),
        "prices": "SELECT CategoryID, median(Price) AS med FROM AdsInfo WHERE Price > 0 GROUP BY 1",
    }, {
        "rate": TOP(RAT("clicks", "n", 0.02)), "history": TOP(f"greatest({NUM('history', 0.02)}, 0)"),
            "category_rate": TOP(f"greatest({NUM('category_rate', 0.02)}, 0)"), "price": LOGK("Price", 13.8),
        "relative_price": f"CASE WHEN coalesce(med, 0) > 0 THEN {TOP('coalesce(Price, 0) / med / 5')} ELSE 0.2::DOUBLE END",
            "shown": LOGK("n", 9.2), "place": CAP("place", 20, 10), "visit_rate": TOP(RAT("visits", "n", 0)),
        "trend": (
            f"CASE WHEN coalesce(n, 0) > 5 AND coalesce(n3, 0) > 2 THEN "
            f"{SH('clicks3::DOUBLE / n3 - clicks::DOUBLE / n', 1)} ELSE 0.5::DOUBLE END"
        ), "is_new": FLAG("n IS NULL"),
    }, "LEFT JOIN AdsInfo ON AdID = task.who " + _left("seen", "visited")
        + " LEFT JOIN rates USING (CategoryID, cutoff) LEFT JOIN prices USING (CategoryID)"),
    "ads_user": ({
        "met": past("SearchInfo", "UserID", "SearchDate"),
        "searches": "SELECT who, cutoff, count(*) AS n, min(d) AS last_search, avg(IsUserLoggedOn) AS logged FROM met GROUP BY 1, 2",
        "visited": (
            f"SELECT who, cutoff, count(*) AS visits, count(*) FILTER (WHERE d <= 3) AS visits3, min(d) AS last_visit, "
            f"count(DISTINCT AdID) AS ads FROM ({past('VisitStream', 'UserID', 'ViewDate')}) GROUP BY 1, 2"
        ),
        "hits": (
            "SELECT who, cutoff, sum(IsClick) AS clicks, count(*) AS shown FROM met JOIN SearchStream s USING (SearchID) "
            "WHERE s.SearchDate < cutoff GROUP BY 1, 2"
        ),
    }, {
        "visits": LOGK("visits", 8.5), "visits3": LOGK("visits3", 4.6), "visit_recency": DECD("last_visit", 4.3, 9999),
            "ads": LOGK("ads", 7.6), "searches": LOGK("n", 9.2), "search_recency": DECD("last_search", 4.3, 9999),
            "rate": TOP(RAT("clicks", "shown", 0)), "shown": LOGK("shown", 10.8), "logged": NUM("logged"),
            "is_new": FLAG("n IS NULL AND visits IS NULL"),
    }, _left("searches", "visited", "hits")),
    "retail_customer": ({
        "bought": (
            f"SELECT *, d - lead(d) OVER (PARTITION BY who, cutoff ORDER BY t_dat) AS gap FROM "
            f"({past('transactions', 'customer_id', 't_dat')})"
        ),
        "agg": (
            "SELECT who, cutoff, min(d) AS last, count(*) FILTER (WHERE d <= 28) AS n28, count(*) FILTER (WHERE d <= 365) "
            "AS n365, count(*) AS n, sum(price) FILTER (WHERE d <= 28) AS spend, count(*) FILTER (WHERE d <= 28) - "
            "count(*) FILTER (WHERE d > 28 AND d <= 56) AS trend, avg((sales_channel_id = 2)::INTEGER) AS online, "
            "count(DISTINCT article_id) AS articles, max(gap) AS longest, date_diff('day', min(t_dat), max(t_dat)) AS span "
            "FROM bought GROUP BY 1, 2"
        ),
    }, {
        "recency": DEC("last", 30), "n28": LOGS("n28", 50), "n365": LOGS("n365", 200), "trend": SH("trend", 20),
            "gap": CAP("CASE WHEN n > 1 THEN span::DOUBLE / (n - 1) END", 90, 90),
            "overdue": "least(greatest(coalesce(last, 9999)::DOUBLE / greatest(coalesce(longest, last, 9999)::DOUBLE, 1), 0), 3) / 3",
        "online": NUM("online", 0.5), "spend": LOGS("spend", 5), "variety": NUM("articles::DOUBLE / n", 1), "age": CAP("age", 80, 35),
            "member": FLAG("club_member_status = 'ACTIVE'"), "is_new": FLAG("n IS NULL"),
    }, _left("agg") + " LEFT JOIN customer c ON c.customer_id = task.who"),
    "retail_article": ({
        "agg": (
            f"SELECT who, cutoff, min(d) AS last, sum(price) FILTER (WHERE d <= 7) AS s7, sum(price) FILTER (WHERE d <= 28) "
            f"AS s28, sum(price) FILTER (WHERE d <= 365) AS s365, count(*) FILTER (WHERE d <= 7) AS n7, count(*) FILTER "
            f"(WHERE d <= 28) AS n28, sum(price) FILTER (WHERE d <= 7) - sum(price) FILTER (WHERE d > 7 AND d <= 14) AS "
            f"trend, count(DISTINCT customer_id) FILTER (WHERE d <= 28) AS buyers, max(d) AS age FROM "
            f"({past('transactions', 'article_id', 't_dat')}) GROUP BY 1, 2"
        ),
        "grp": (
            "SELECT product_group_name, cutoff, sum(price) FILTER (WHERE date_diff('day', t_dat, cutoff) <= 7) AS g7, "
            "count(DISTINCT article_id) FILTER (WHERE date_diff('day', t_dat, cutoff) <= 28) AS items FROM (SELECT "
            "DISTINCT cutoff FROM task) JOIN transactions ON t_dat < cutoff JOIN article USING (article_id) GROUP BY 1, 2"
        ),
    }, {
        "s7": LOGS("s7", 5), "s28": LOGS("s28", 20), "s365": LOGS("s365", 100), "n7": LOGS("n7", 200), "trend": SH("trend", 2),
            "recency": DEC("last", 10), "buyers": LOGS("buyers", 500), "age": LOGS("age", 1000), "group7": LOGS("g7", 500),
            "share": TOP(RAT("n28", "items", 0)), "spend": LOGS("s28", 20), "is_new": FLAG("coalesce(age, 0) < 30"),
            "never": FLAG("last IS NULL"),
    }, _left("agg") + " LEFT JOIN article ON article_id = task.who LEFT JOIN grp USING (product_group_name, cutoff)"),
    "forum_user": (_FORUM, {
        "recency": _NEAR("last_post", "last_comment", "last_vote"), "post_recency": DEC("last_post", 87),
            "active90": LOGS(_SUMS("posts90", "comments90", "votes90"), 50), "posts90": LOGS("posts90", 30),
            "posted": FLAG("coalesce(posts30, 0) > 0"), "posts": LOGS("posts", 500),
        "answers": RAT("answers", "posts", 0), "badges": LOGS("badges", 200), "age": LOGS("age", 3650), "edits90": LOGS("edits90", 50),
            "received": LOGS("received", 5000), "votes90": LOGS("votes90", 200),
    }, _FORUM_FROM),
    "forum_badge": (_FORUM, {
        "recency": _NEAR("last_post", "last_comment"), "active90": LOGS(_SUMS("posts90", "comments90"), 50),
            "posted": FLAG("coalesce(posts30, 0) > 0"), "momentum": CAP("badges90", 5, 0), "badges": LOGS("badges", 200),
            "gold": FLAG("coalesce(gold, 0) > 0"),
        "received": LOGS("received", 5000), "posts": LOGS("posts", 500), "age": LOGS("age", 3650), "edits90": LOGS("edits90", 50),
            "votes90": LOGS("votes90", 200), "comments90": LOGS("comments90", 50),
    }, _FORUM_FROM),
    "forum_post": ({
        "own": past("posts", "Id", "CreationDate", "f.PostTypeId, f.OwnerUserId"),
        "got": (
            f"SELECT who, cutoff, count(*) FILTER (WHERE VoteTypeId = 2 AND d <= 90) AS up90, count(*) FILTER (WHERE "
            f"VoteTypeId = 2) AS up, count(*) FILTER (WHERE VoteTypeId = 3) AS down, count(*) FILTER (WHERE VoteTypeId = 2 "
            f"AND d <= 30) - count(*) FILTER (WHERE VoteTypeId = 2 AND d > 30 AND d <= 60) AS trend FROM "
            f"({past('votes', 'PostId', 'CreationDate')}) GROUP BY 1, 2"
        ),
        "talk": f"SELECT who, cutoff, count(*) AS comments FROM ({past('comments', 'PostId', 'CreationDate')}) GROUP BY 1, 2",
        "edits": f"SELECT who, cutoff, count(*) AS edits FROM ({past('postHistory', 'PostId', 'CreationDate')}) GROUP BY 1, 2",
        "owners": "SELECT DISTINCT OwnerUserId AS who, cutoff FROM own",
        "fame": (
            f"SELECT p.who AS OwnerUserId, p.cutoff, count(*) AS fame FROM "
            f"({past('posts', 'OwnerUserId', 'CreationDate', 'f.Id', 'owners')}) p JOIN votes v ON v.PostId = p.Id AND "
            f"v.VoteTypeId = 2 AND v.CreationDate < p.cutoff GROUP BY 1, 2"
        ),
        "asked": "SELECT who, cutoff FROM own WHERE PostTypeId = 1",
        "solved": (
            f"SELECT p.who, p.cutoff, max((VoteTypeId = 1)::INTEGER) AS solved FROM "
            f"({past('posts', 'ParentId', 'CreationDate', 'f.Id', 'asked')}) p JOIN votes v ON v.PostId = p.Id AND "
            f"v.CreationDate < p.cutoff GROUP BY 1, 2"
        ),
    }, {
        "up90": LOGS("up90", 50), "up": LOGS("up", 500), "speed": TOP(RAT("up", "own.d", 0)), "trend": SH("trend", 10),
            "approval": RAT("up", f"({_SUMS('up', 'down')})", 0.5), "fresh": DECD("own.d", 260, 0), "comments": LOGS("comments", 50),
            "answer": FLAG("PostTypeId = 2"),
        "age": LOGS("greatest(coalesce(own.d, 0), 0)", 3650), "fame": LOGS("fame", 10000), "solved": NUM("solved"),
            "edits": LOGS("edits", 30),
    }, _left("own", "got", "talk", "edits", "solved") + " LEFT JOIN fame USING (OwnerUserId, cutoff)"),
    "reviews_customer": ({
        "agg": (
            f"SELECT who, cutoff, min(d) AS last, count(*) FILTER (WHERE d <= 30) AS n30, count(*) FILTER (WHERE d <= 90) "
            f"AS n90, count(*) AS n, avg(rating) AS rating, stddev_pop(rating) AS spread, count(*) FILTER (WHERE rating <= "
            f"2) AS low, avg(verified::INTEGER) AS verified, avg(price) FILTER (WHERE price > 0) AS price, sum(price) "
            f"FILTER (WHERE price > 0 AND d <= 365) AS spend1, sum(price) FILTER (WHERE price > 0) AS spend, count(DISTINCT "
            f"product_id) AS products, count(DISTINCT category) AS categories, count(*) FILTER (WHERE d <= 90) - count(*) "
            f"FILTER (WHERE d > 90 AND d <= 180) AS trend FROM ({_REVIEWED('customer_id')}) GROUP BY 1, 2"
        ),
    }, {
        "recency": DEC("last", 87), "n30": LOGS("n30", 20), "n90": LOGS("n90", 30), "n": LOGS("n", 500),
            "rating": "(coalesce(rating, 3) - 1) / 4", "spread": CAP("spread", 2, 0), "low": RAT("low", "n", 0),
            "verified": NUM("verified", 0.5), "price": LOGS("price", 500), "spend1": LOGS("spend1", 5000), "spend": LOGS("spend", 10000),
        "products": LOGS("products", 200), "categories": LOGS("categories", 50), "trend": SH("trend", 20), "is_new": FLAG("n IS NULL"),
    }, _left("agg")),
    "reviews_product": ({
        "agg": (
            f"SELECT who, cutoff, min(d) AS last, count(*) FILTER (WHERE d <= 90) AS n90, count(*) AS n, avg(rating) AS "
            f"rating, stddev_pop(rating) AS spread, avg(verified::INTEGER) AS verified, count(DISTINCT customer_id) AS "
            f"people, count(DISTINCT customer_id) FILTER (WHERE d <= 365) AS people1, sum(price) FILTER (WHERE d <= 365) AS "
            f"revenue, max(d) AS age, count(*) FILTER (WHERE d <= 30) - count(*) FILTER (WHERE d > 30 AND d <= 60) AS "
            f"trend30, count(*) FILTER (WHERE d <= 90) - count(*) FILTER (WHERE d > 90 AND d <= 180) AS trend90 FROM "
            f"({_REVIEWED('product_id')}) GROUP BY 1, 2"
        ),
    }, {
        "recency": DEC("last", 87), "n90": LOGS("n90", 30), "n": LOGS("n", 1000), "rating": "(coalesce(rating, 3) - 1) / 4",
            "spread": CAP("spread", 2, 0), "verified": NUM("verified", 0.5), "people": LOGS("people", 500),
            "people1": LOGS("people1", 200), "price": LOGS("g.price", 500), "revenue": LOGS("revenue", 50000),
        "age": LOGS("age", 2000), "trend30": SH("trend30", 10), "trend90": SH("trend90", 20), "is_new": FLAG("n IS NULL"),
    }, _left("agg") + " LEFT JOIN product g ON g.product_id = task.who"),
    "invited_user": ({
        "met": (
            f"SELECT *, status IN ('yes', 'maybe') AS went, status = 'invited' AS asked FROM "
            f"({past('event_attendees', 'user_id', 'start_time', 'f.status')})"
        ),
        "agg": (
            "SELECT who, cutoff, count(*) AS n, min(d) FILTER (WHERE went) AS last, min(d) FILTER (WHERE asked) AS "
            "last_asked, count(*) FILTER (WHERE went AND d <= 7) AS w7, count(*) FILTER (WHERE went AND d <= 14) AS w14, "
            "count(*) FILTER (WHERE went AND d <= 90) AS w90, count(*) FILTER (WHERE went AND d <= 7) - count(*) FILTER "
            "(WHERE went AND d > 7 AND d <= 14) AS trend, count(*) FILTER (WHERE asked AND d <= 7) AS a7, count(*) FILTER "
            "(WHERE asked AND d <= 90) AS a90, count(*) FILTER (WHERE status = 'yes') AS yes, count(*) FILTER (WHERE "
            "status IN ('yes', 'maybe', 'no')) AS answered FROM met GROUP BY 1, 2"
        ),
        "liked": (
            f"SELECT who, cutoff, count(*) AS m, avg(CASE WHEN invited = 1 THEN interested END) AS interest, avg(CASE WHEN "
            f"invited = 1 THEN not_interested END) AS ignored FROM ({past('event_interest', 'usr', 'timestamp')}) GROUP BY "
            f"1, 2"
        ),
        "pals": "SELECT usr, count(*) AS friends FROM user_friends GROUP BY 1",
    }, {
        "recency": DEC("last", 20), "asked_recency": DEC("last_asked", 20), "w7": LOGS("w7", 30), "w14": LOGS("w14", 50),
            "w90": LOGS("w90", 200), "trend": SH("trend", 10), "yes_rate": RAT("yes", "answered", 0.5), "a7": LOGS("a7", 30),
            "a90": LOGS("a90", 200), "interest": NUM("interest", 0.3), "ignored": NUM("ignored", 0.1),
        "friends": LOGS("friends", 5000), "age": LOGS("greatest(coalesce(date_diff('day', joinedAt, task.cutoff), 0), 0)", 3650),
            "is_new": FLAG("n IS NULL AND m IS NULL"),
    }, _left("agg", "liked") + " LEFT JOIN pals ON usr = task.who LEFT JOIN users u ON u.user_id = task.who"),
}


def program_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The product program's vectors by node id: the whole wrapper around a program."""
    labels = label_rows(spark, sf, "reviews_product").select((F.col("who") * 10000 + F.year("cutoff")).alias("node_id"),
        F.col("who").alias("product_id"), F.col("cutoff").alias("timestamp"))
    found = P.PROGRAMS["reviews", "item-ltv"].vectors(labels, database(spark, sf, "reviews"))
    return found.select("node_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in found.columns if c != "node_id"])


_VECTOR = {n: f"(({x}) - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({x}) OVER () END" for n,
    x in TEXTS["reviews_product"][1].items()}
VECTORS_SQL = (
    f"SELECT who * 10000 + year(cutoff) AS node_id, "
    f"{', '.join(f'round({n}::FLOAT::DOUBLE, 4) AS {n}' for n in _VECTOR)} FROM "
    f"({_text('reviews_product', TEXTS['reviews_product'][0], _VECTOR, TEXTS['reviews_product'][2]).replace(', 6) AS', ', 12) AS')})"
)

QUERIES = {f"program_{name}": (_query(name), _text(name, *TEXTS[name])) for name in SPINES}
QUERIES["program_vectors"] = (program_vectors, VECTORS_SQL)
