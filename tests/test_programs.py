"""The thirteen programs on random tables: nothing after the cutoff matters, and features stay in range."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.plans.programs import PROGRAMS

CUT = dt.datetime(2021, 6, 1)


def rows(n, seed, **columns):
    rng = random.Random(seed)
    return [tuple(c(rng) if callable(c) else c for c in columns.values()) for _ in range(n)]


key = lambda n: lambda r: r.randrange(n)
pick = lambda *v: lambda r: r.choice(v)
real = lambda hi: lambda r: round(r.random() * hi, 3)
when = lambda r: CUT + dt.timedelta(hours=r.randrange(-24 * 700, 24 * 60))

T = "timestamp_ntz"
#: database -> table -> (time column, rows, column -> (type, maker))
TABLES = {
    "racing": {
        "results": ("date", 300, {"driverId": ("long", key(8)), "raceId": ("long", key(90)), "constructorId": ("long", key(3)), "positionOrder": ("long", key(20)), "grid": ("long", key(20)), "statusId": ("long", pick(1, 1, 4)), "date": (T, when)}),
        "qualifying": ("date", 200, {"driverId": ("long", key(8)), "position": ("long", key(20)), "date": (T, when)}),
        "constructor_standings": ("date", 90, {"constructorId": ("long", key(3)), "position": ("long", key(10)), "date": (T, when)}),
    },
    "trials": {
        "studies": (None, 40, {"nct_id": ("long", None), "phase": ("string", pick("Phase 3", "Phase 1", None)), "enrollment": ("long", key(900)), "has_dmc": ("string", pick("Yes", "No")), "start_date": (T, when), "study_type": ("string", pick("Interventional", "Other"))}),
        "designs": ("date", 60, {"nct_id": ("long", key(40)), "masking": ("string", pick("Single", "Double", None)), "date": (T, when)}),
        "facilities_studies": ("date", 300, {"facility_id": ("long", key(8)), "nct_id": ("long", key(40)), "date": (T, when)}),
        "sponsors_studies": ("date", 120, {"sponsor_id": ("long", key(6)), "nct_id": ("long", key(40)), "date": (T, when)}),
        "conditions_studies": ("date", 120, {"condition_id": ("long", key(6)), "nct_id": ("long", key(40)), "date": (T, when)}),
        "sponsors": (None, 6, {"sponsor_id": ("long", None), "agency_class": ("string", pick("Industry", "Other"))}),
        "outcome_analyses": ("date", 200, {"nct_id": ("long", key(40)), "p_value": ("double", real(1)), "date": (T, when)}),
    },
    "ads": {
        "AdsInfo": (None, 8, {"AdID": ("long", None), "CategoryID": ("long", key(3)), "Price": ("double", real(90))}),
        "SearchStream": ("SearchDate", 500, {"SearchID": ("long", key(150)), "AdID": ("long", key(8)), "SearchDate": (T, when), "IsClick": ("long", pick(0, 1)), "Position": ("long", key(9)), "HistCTR": ("double", real(1))}),
        "VisitStream": ("ViewDate", 200, {"UserID": ("long", key(8)), "AdID": ("long", key(8)), "ViewDate": (T, when)}),
        "SearchInfo": ("SearchDate", 150, {"SearchID": ("long", None), "UserID": ("long", key(8)), "SearchDate": (T, when), "IsUserLoggedOn": ("long", pick(0, 1))}),
    },
    "retail": {
        "transactions": ("t_dat", 500, {"t_dat": (T, when), "customer_id": ("long", key(8)), "article_id": ("long", key(8)), "price": ("double", real(1)), "sales_channel_id": ("long", pick(1, 2))}),
        "customer": (None, 8, {"customer_id": ("long", None), "age": ("double", pick(20.0, None)), "club_member_status": ("string", pick("ACTIVE", None))}),
        "article": (None, 8, {"article_id": ("long", None), "product_group_name": ("string", pick("a", "b"))}),
    },
    "forum": {
        "users": (None, 8, {"Id": ("long", None), "CreationDate": (T, when)}),
        "posts": ("CreationDate", 60, {"Id": ("long", None), "OwnerUserId": ("long", key(8)), "PostTypeId": ("long", pick(1, 2)), "ParentId": ("long", key(60)), "CreationDate": (T, when)}),
        "comments": ("CreationDate", 200, {"PostId": ("long", key(60)), "UserId": ("long", key(8)), "CreationDate": (T, when)}),
        "votes": ("CreationDate", 300, {"UserId": ("long", key(8)), "PostId": ("long", key(60)), "VoteTypeId": ("long", pick(1, 2, 3)), "CreationDate": (T, when)}),
        "badges": ("Date", 60, {"UserId": ("long", key(8)), "Class": ("long", pick(1, 3)), "Date": (T, when)}),
        "postHistory": ("CreationDate", 100, {"PostId": ("long", key(60)), "UserId": ("long", key(8)), "CreationDate": (T, when)}),
    },
    "reviews": {
        "review": ("review_time", 400, {"review_time": (T, when), "customer_id": ("long", key(8)), "product_id": ("long", key(8)), "rating": ("double", pick(1.0, 3.0, 5.0)), "verified": ("boolean", pick(True, False))}),
        "product": (None, 8, {"product_id": ("long", None), "category": ("string", pick("a", "b")), "price": ("double", pick(0.0, 9.5, None))}),
    },
    "invitations": {
        "event_attendees": ("start_time", 300, {"user_id": ("long", key(8)), "status": ("string", pick("yes", "no", "maybe", "invited")), "start_time": (T, when)}),
        "event_interest": ("timestamp", 200, {"user": ("long", key(8)), "invited": ("long", pick(0, 1)), "interested": ("long", pick(0, 1)), "not_interested": ("long", pick(0, 1)), "timestamp": (T, when)}),
        "user_friends": (None, 50, {"user": ("long", key(8)), "friend": ("long", key(8))}),
        "users": (None, 8, {"user_id": ("long", None), "joinedAt": (T, when)}),
    },
}


def frame(spark, name, n, columns):
    made = rows(n, name, **{c: m for c, (_, m) in columns.items()})
    serial = [i for i, (_, m) in enumerate(columns.values()) if m is None]
    made = [tuple(k if i in serial else v for i, v in enumerate(r)) for k, r in enumerate(made)]
    return spark.createDataFrame(made, ", ".join(f"`{c}` {t}" for c, (t, _) in columns.items())).coalesce(1)


@pytest.mark.parametrize("area, task", sorted({(a, next(t for (b, t), q in PROGRAMS.items() if q is p)) for (a, _), p in PROGRAMS.items()}))
def test_program(spark, area, task):
    program = PROGRAMS[area, task]
    full = {t: frame(spark, t, n, columns) for t, (_, n, columns) in TABLES[area].items()}
    cut = {t: df.where(F.col(TABLES[area][t][0]) < F.lit(CUT)) if TABLES[area][t][0] else df for t, df in full.items()}
    labels = spark.createDataFrame([(i, CUT) for i in [*range(8), 999, 3]], f"`{program.entity}` long, `{program.time}` timestamp_ntz")
    plain = lambda db: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in program(labels, db).collect())
    got = plain(full)
    assert len(got) == 9 and got == plain(cut)
    assert all(v is not None and 0 <= v <= 1.2 for r in got for v in r if isinstance(v, float))
    assert len({r[2:] for r in got}) > 4


def test_static_rows_stored_twice_do_not_fan_out(spark):
    for area, task in (("trials", "study-outcome"), ("trials", "site-success"), ("ads", "ad-ctr"), ("retail", "user-churn"), ("retail", "item-sales"), ("forum", "user-badge"), ("reviews", "item-ltv"), ("reviews", "user-ltv"), ("invitations", "user-ignore")):
        program = PROGRAMS[area, task]
        db = {t: frame(spark, t, n, columns) for t, (_, n, columns) in TABLES[area].items()}
        twice = {t: df.union(df) if TABLES[area][t][0] is None and t != "user_friends" else df for t, df in db.items()}
        labels = spark.createDataFrame([(i, CUT) for i in range(8)], f"`{program.entity}` long, `{program.time}` timestamp_ntz")
        plain = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found.collect())
        assert plain(program(labels, db)) == plain(program(labels, twice))


def test_vectors_are_scaled_over_all_or_the_chosen_rows(spark):
    program = PROGRAMS["reviews", "user-ltv"]
    db = {t: frame(spark, t, n, columns) for t, (_, n, columns) in TABLES["reviews"].items()}
    labels = spark.createDataFrame([(100 + i, i % 9, CUT, "train" if i < 6 else "test") for i in range(12)] + [(200, None, CUT, "test")], "node_id long, customer_id long, timestamp timestamp_ntz, split string")
    for fit in (None, F.col("split") == "train"):
        got = {r.node_id: r for r in program.vectors(labels, db, fit_on=fit).collect()}
        assert len(got) == 13 and got[100][1:] == got[109][1:]
        base = [r.recency for n, r in got.items() if fit is None or n < 106]
        assert sum(base) == pytest.approx(0, abs=1e-5) and sum(v * v for v in base) / len(base) == pytest.approx(1, abs=1e-4)


def test_sums_before_equal_plain_sums(spark):
    from chronofold.operators.history import sums_before

    rng = random.Random(4)
    facts = [(rng.choice("abc"), CUT + dt.timedelta(hours=rng.randrange(300)), rng.randrange(9)) for _ in range(200)]
    asked = [(g, CUT + dt.timedelta(hours=h)) for g in "abcd" for h in (0, 7, 24, 25, 168, 400)] + [("a", facts[0][1])]
    got = sums_before(spark.createDataFrame(facts, "g string, t timestamp_ntz, v long"), spark.createDataFrame(asked, "g string, cutoff timestamp_ntz"), ["g"], "t", ["v"]).collect()
    want = {(g, c): sum(v for h, t, v in facts if h == g and t < c) if any(h == g and t < c for h, t, _ in facts) else None for g, c in asked}
    assert {(r.g, r.cutoff): r.v for r in got} == want and len(got) == len(want)


def _most_rows(df):
    """The most rows that any join of the plan that ran has made."""
    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        made = plan.metrics().get("numOutputRows")
        own = made.get().value() if "Join" in kind and made.isDefined() else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_trial_study_lists_no_popular_groups(spark):
    """1000 studies share two sponsors, three others share two of their own: the counts are exact, the popular pairs unlisted."""
    from chronofold.plans.programs import trial_study

    at = dt.datetime(2000, 1, 1)
    links = [(s, i, at) for i in range(1000) for s in (1, 2)] + [(s, i, at) for i in (1000, 1001, 1002) for s in (3, 4)]
    db = {
        "sponsors_studies": spark.createDataFrame(links, "sponsor_id long, nct_id long, date timestamp_ntz"),
        "conditions_studies": spark.createDataFrame([(1, 1000, at)], "condition_id long, nct_id long, date timestamp_ntz"),
        "outcome_analyses": spark.createDataFrame([(1000, 0.25, at)], "nct_id long, p_value double, date timestamp_ntz"),
        "designs": spark.createDataFrame([(0, "Single", at)], "nct_id long, masking string, date timestamp_ntz"),
        "facilities_studies": spark.createDataFrame([(1, 0, at)], "facility_id long, nct_id long, date timestamp_ntz"),
        "studies": spark.createDataFrame([(0, "Phase 3", 5, "Yes", at)], "nct_id long, phase string, enrollment long, has_dmc string, start_date timestamp_ntz"),
    }
    task = spark.range(1003).selectExpr("id AS who", "TIMESTAMP_NTZ'2001-01-01' AS cutoff")
    found = trial_study(task, db)
    got = {r.who: r.sponsor_studies for r in found.collect()}
    assert {got[i] for i in range(1000)} == {1.0}
    assert all(abs(got[i] - math.log(3) / math.log(500)) < 1e-12 for i in (1000, 1001, 1002))
    assert _most_rows(found) < 10_000
