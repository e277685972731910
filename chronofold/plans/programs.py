"""The feature programs of the benchmark's databases: thirteen programs for twenty-one forecast tasks.

A program takes the label rows (cutoff, who) and the database's tables by name, and gives a row of normalised
features for each label row. Facts are strictly earlier than the cutoff unless a table is static. Each fact table is
joined once and all its aggregates are taken in one pass. Feature order, scales and defaults are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import capped, centred, days_between, decay, flag, log_ratio, log_scaled, num, ratio
from ..operators.history import avg_if, before, count_if, dedup_first, first_by, spread, sum_if, sums_before, zscored
from ..sources.shared import materialise

KEYS = ["who", "cutoff"]


class _DaysAgo:
    """days_ago as a column, made when it is used: columns need a session."""

    def __le__(self, days: int) -> Column:
        return F.col("days_ago") <= days

    def __gt__(self, days: int) -> Column:
        return F.col("days_ago") > days

    def __sub__(self, other: Column) -> Column:
        return F.col("days_ago") - other


D = _DaysAgo()


def past(task: DataFrame, facts: DataFrame, key: str, time: str) -> DataFrame:
    """Label rows with their entity's earlier facts; days_ago is the fact's."""
    renamed = facts.withColumnsRenamed({c: f"fact_{c}" for c in facts.columns if c in KEYS})
    return before(task, renamed, [("who", f"fact_{key}" if key in KEYS else key)], f"fact_{time}" if time in KEYS else time)


def onto(task: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        task = task.join(spread(part), [k for k in KEYS if k in part.columns], "left")
    return task


def once(table: DataFrame, key: str) -> DataFrame:
    """A static table with one row for each key, should one be stored twice."""
    return dedup_first(table, [key])


def mean(x: Column | str, default: float) -> Column:
    return num(x, default)


def rating(x: str) -> Column:
    return (num(x, 3) - 1) / 4


def racing_driver(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    order, grid, failed = F.col("positionOrder"), F.col("grid"), F.col("statusId") != 1
    year = D <= 365
    results = db["results"]
    # Equal times are decided by the race's remaining columns, so a run always gives the same row.
    latest = ["days_ago", *[c for c in ("raceId", "constructorId", "positionOrder", "grid", "statusId") if c in results.columns]]
    own = past(task, results, "driverId", "date").groupBy(*KEYS).agg(
        F.count("*").alias("n"), count_if(year).alias("n1"), avg_if(order, year).alias("finish"),
            avg_if(grid, year & (grid > 0)).alias("start"), count_if(order <= 3).alias("podia"),
            count_if((order <= 3) & year).alias("podia1"),
        count_if(failed).alias("out"), count_if(failed & year).alias("out1"), first_by("constructorId", *latest).alias("team"),
            first_by("positionOrder", *latest).alias("last"), first_by(F.when(failed, 1).otherwise(0), *latest).alias("last_out"))
    quali = past(task, db["qualifying"], "driverId", "date").groupBy(*KEYS).agg(avg_if("position", year).alias("quali"))
    teams = own.where("team IS NOT NULL").select("team", "cutoff").distinct().withColumnRenamed("team", "who")
    standing = past(teams, db["constructor_standings"], "constructorId",
        "date").groupBy(*KEYS).agg(first_by("position", "days_ago", "position").alias("standing")).withColumnRenamed("who", "team")
    pace = past(teams, results, "constructorId", "date").groupBy(*KEYS).agg(avg_if(order, year).alias("pace")).withColumnRenamed("who",
        "team")
    full = onto(task, own, quali).join(standing, ["team", "cutoff"], "left").join(pace, ["team", "cutoff"], "left")
    return full.select(*KEYS,
        capped("finish", 20, 13).alias("finish"), capped("start", 20, 13).alias("start"), ratio("podia", "n", 0).alias("podium_rate"),
            ratio("podia1", "n1", 0).alias("podium_rate_year"), ratio("out", "n", 0.5).alias("out_rate"),
            ratio("out1", "n1", 0.5).alias("out_rate_year"),
        capped("last", 20, 13).alias("last_finish"), num("last_out").alias("last_out"), capped("quali", 20, 13).alias("quali"),
            capped("standing", 10, 6).alias("standing"), capped("pace", 20, 13).alias("team_finish"),
            centred(num("finish", 13) - num("pace", 13), 20).alias("against_team"))


def trial_study(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    masks = {"None (Open Label)": 0.0, "Single": 0.25, "Double": 0.5, "Triple": 0.75, "Quadruple": 1.0}
    analyses = db["outcome_analyses"].select(F.col("nct_id").alias("study"), "p_value", F.col("date").alias("found"))

    def peers(links: DataFrame, key: str, enough: int | None = None) -> DataFrame:
        """Other studies that share a sponsor or condition, with their analyses; every pair of links counts.

        A study's sums are its groups' totals less its own share, so a popular condition costs its links and not their
        pairs. Distinct others are the group's studies less one; only for studies of several groups they are listed. Where a
        count from `enough` on says no more than `enough`, a study with a group of that many others needs no list either, so
        what is listed is at most `enough` others for each link, however large the groups are.
        """
        own = past(task, links.select("nct_id", key, "date"), "nct_id", "date").where(F.col(key).isNotNull()).groupBy(*KEYS,
            key).agg(F.count("*").alias("times"))
        groups = own.select(key, "cutoff").distinct()
        inside = groups.join(spread(links.select(F.col("nct_id").alias("study"), key, F.col("date").alias("linked"))),
            key).where("linked < cutoff AND study IS NOT NULL")
        inside = inside.groupBy(key, "cutoff", "study").agg(F.count("*").alias("links"))
        seen = inside.select("study", "cutoff").distinct().join(spread(analyses), "study").where("found < cutoff")
        told = seen.groupBy("study", "cutoff").agg(F.sum("p_value").alias("p"), F.count("p_value").alias("c"),
            count_if(F.col("p_value") < 0.05).alias("h"))
        known = inside.join(spread(told), ["study", "cutoff"], "left").fillna(0, ["p", "c", "h"])
        sums = [F.sum(F.col(x) * F.col("links")).alias(f"all_{x}") for x in "pch"]
        totals = known.groupBy(key, "cutoff").agg(*sums, F.count("*").alias("studies"))
        mine = known.select(key, "cutoff", F.col("study").alias("who"), *[(F.col(x) * F.col("links")).alias(f"own_{x}") for x in "pch"])
        shared = own.join(spread(totals), [key, "cutoff"]).join(spread(mine), [*KEYS, key])
        less = {x: F.sum((F.col(f"all_{x}") - F.col(f"own_{x}")) * F.col("times")).alias(x) for x in "pch"}
        out = shared.groupBy(*KEYS).agg(*less.values(), F.count("*").alias("groups"), F.max(F.col("studies") - 1).alias("alone"))
        counted = F.col("groups") > 1 if enough is None else (F.col("groups") > 1) & (F.col("alone") < enough)
        listed = own.join(spread(out.where(counted).select(*KEYS)), KEYS, "left_semi").select(*KEYS, key).join(
            spread(inside.select(key, "cutoff", "study")), [key, "cutoff"]).where("study <> who")
        listed = listed.groupBy(*KEYS).agg(F.count_distinct("study").alias("listed"))
        full = out.join(spread(listed), KEYS, "left")
        count = F.when(counted, F.coalesce("listed", F.lit(0))).otherwise(F.col("alone"))
        return full.select(*KEYS, F.try_divide("p", F.when(F.col("c") > 0, F.col("c"))).alias(f"{key}_p"), count.alias(f"{key}_n"),
            F.col("h").alias(f"{key}_hits"))

    study = task.join(spread(once(db["studies"], "nct_id").select(F.col("nct_id").alias("who"), "phase", "enrollment", "has_dmc",
        "start_date")), "who", "left")
    # One row a study: where a study has several designs, the one that is smallest by text.
    design = past(task, db["designs"].select("nct_id", "masking", "date"), "nct_id",
        "date").groupBy(*KEYS).agg(F.min("masking").alias("masking"))
    sites = past(task, db["facilities_studies"].select("nct_id", "facility_id", "date"), "nct_id",
        "date").groupBy(*KEYS).agg(F.count_distinct("facility_id").alias("sites"))
    # The feature of 499 other studies or more is 1.
    full = onto(study, design, sites, peers(db["sponsors_studies"], "sponsor_id", 499), peers(db["conditions_studies"], "condition_id"))
    masked = F.coalesce(F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])[F.col("masking")], F.lit(0.0))
    return full.select(*KEYS,
        mean("sponsor_id_p", 0.5).alias("sponsor_p"), F.least(F.log(1 + num("sponsor_id_n")) / F.log(F.lit(500.0)),
            F.lit(1.0)).alias("sponsor_studies"), mean("condition_id_p", 0.5).alias("condition_p"),
            F.least(ratio("condition_id_hits", "condition_id_n", 0.3), F.lit(1.0)).alias("condition_hits"),
        log_ratio("enrollment", 10.8).alias("enrolled"), decay(days_between("cutoff", "start_date"), 730, 0).alias("recency"),
            flag(F.col("phase").isin("Phase 3", "Phase 4", "Phase 2/Phase 3")).alias("late"),
            flag(F.col("has_dmc") == "Yes").alias("monitored"), masked.alias("masking"), log_ratio("sites", 6.9).alias("sites"))


def trial_site(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    met = past(task, db["facilities_studies"].select("facility_id", "nct_id", "date"), "facility_id", "date").select(*KEYS, "nct_id",
        "days_ago")
    counts = met.groupBy(*KEYS).agg(F.count_distinct("nct_id").alias("n"), F.count_distinct(F.when(D <= 365, F.col("nct_id"))).alias("n1"))
    kinds = met.join(once(db["studies"], "nct_id").select("nct_id", "phase", "study_type"),
        "nct_id").groupBy(*KEYS).agg(F.avg(flag(F.col("phase").isin("Phase 3", "Phase 4"))).alias("late"),
        F.avg(flag(F.col("study_type") == "Interventional")).alias("active"))
    found = met.join(db["outcome_analyses"].select("nct_id", "p_value", F.col("date").alias("at")),
        "nct_id").where("at < cutoff").groupBy(*KEYS).agg(count_if(F.col("p_value") < 0.05).alias("hits"), F.count("*").alias("analyses"))
    paid = met.join(db["sponsors_studies"].select("nct_id", "sponsor_id", F.col("date").alias("at")),
        "nct_id").where("at < cutoff").join(once(db["sponsors"], "sponsor_id").select("sponsor_id", "agency_class"),
        "sponsor_id").groupBy(*KEYS).agg(F.max(flag(F.col("agency_class") == "Industry")).alias("industry"))
    return onto(task, counts, kinds, found, paid).select(*KEYS,
        ratio("hits", "analyses", 0.44).alias("hit_rate"), log_ratio("n", 6.2).alias("studies"), ratio("n1", "n", 0).alias("recent"),
            num("late").alias("late"), num("active").alias("interventional"), num("industry").alias("industry"),
            flag(F.col("analyses").isNotNull()).alias("has_outcome"), flag(F.col("n").isNull()).alias("is_new"))


def ads_ad(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    ads = once(db["AdsInfo"], "AdID").select(F.col("AdID").alias("who"), "CategoryID", "Price")
    shown = db["SearchStream"].select("AdID", "SearchDate", "IsClick", "Position", "HistCTR")
    seen = past(task, shown, "AdID", "SearchDate").groupBy(*KEYS).agg(
        F.count("*").alias("n"), count_if(D <= 3).alias("n3"), F.sum("IsClick").alias("clicks"), sum_if("IsClick", D <= 3).alias("clicks3"),
            F.avg("Position").alias("place"), F.avg("HistCTR").alias("history"))
    visits = past(task, db["VisitStream"].select("AdID", "ViewDate"), "AdID", "ViewDate").groupBy(*KEYS).agg(F.count("*").alias("visits"))
    # The stream is added up by category and time, and each cutoff reads its sums off: no cutoff meets the stream.
    clicked = shown.join(ads.select(F.col("who").alias("AdID"), "CategoryID"), "AdID").where("IsClick IS NOT NULL").select("CategoryID",
        "SearchDate", F.col("IsClick").alias("s"), F.lit(1).alias("c"))
    asked = task.join(ads.select("who", "CategoryID"), "who").where("CategoryID IS NOT NULL").select("CategoryID", "cutoff").distinct()
    category = sums_before(clicked, asked, ["CategoryID"], "SearchDate", ["s", "c"]).select("CategoryID", "cutoff",
        F.try_divide("s", "c").alias("category_rate"))
    prices = ads.where("Price > 0").groupBy("CategoryID").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY Price)").alias("median"))
    full = onto(task.join(ads, "who", "left"), seen, visits).join(category, ["CategoryID", "cutoff"], "left").join(prices, "CategoryID",
        "left")
    share = F.lit(1.0)
    trend = F.when((num("n") > 5) & (num("n3") > 2), centred(F.col("clicks3") / F.col("n3") - F.col("clicks") / F.col("n"),
        1)).otherwise(0.5)
    return full.select(*KEYS,
        F.least(ratio("clicks", "n", 0.02), share).alias("rate"),
            F.least(F.greatest(num("history", 0.02), F.lit(0.0)), share).alias("history"),
            F.least(F.greatest(num("category_rate", 0.02), F.lit(0.0)), share).alias("category_rate"),
            log_ratio("Price", 13.8).alias("price"),
        F.when(num("median") > 0, F.least(num("Price") / num("median") / 5, share)).otherwise(0.2).alias("relative_price"),
            log_ratio("n", 9.2).alias("shown"), capped("place", 20, 10).alias("place"),
            F.least(ratio("visits", "n", 0), share).alias("visit_rate"), trend.alias("trend"), flag(F.col("n").isNull()).alias("is_new"))


def ads_user(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    met = past(task, db["SearchInfo"].select("UserID", "SearchID", "SearchDate", "IsUserLoggedOn"), "UserID", "SearchDate")
    searches = met.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("days_ago").alias("last_search"),
        F.avg("IsUserLoggedOn").alias("logged"))
    visits = past(task, db["VisitStream"].select("UserID", "AdID", "ViewDate"), "UserID",
        "ViewDate").groupBy(*KEYS).agg(F.count("*").alias("visits"), count_if(D <= 3).alias("visits3"),
        F.min("days_ago").alias("last_visit"), F.count_distinct("AdID").alias("ads"))
    clicks = met.select(*KEYS, "SearchID").join(db["SearchStream"].select("SearchID", "IsClick", F.col("SearchDate").alias("at")),
        "SearchID").where("at < cutoff").groupBy(*KEYS).agg(F.sum("IsClick").alias("clicks"), F.count("*").alias("shown"))
    return onto(task, searches, visits, clicks).select(*KEYS,
        log_ratio("visits", 8.5).alias("visits"), log_ratio("visits3", 4.6).alias("visits3"),
            decay("last_visit", 4.3).alias("visit_recency"), log_ratio("ads", 7.6).alias("ads"), log_ratio("n", 9.2).alias("searches"),
            decay("last_search", 4.3).alias("search_recency"),
        F.least(ratio("clicks", "shown", 0), F.lit(1.0)).alias("rate"), log_ratio("shown", 10.8).alias("shown"),
            num("logged").alias("logged"), flag(F.col("n").isNull() & F.col("visits").isNull()).alias("is_new"))


def retail_customer(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    bought = past(task, db["transactions"].select("t_dat", "customer_id", "article_id", "price", "sales_channel_id"), "customer_id",
        "t_dat")
    gap = D - F.lead("days_ago").over(Window.partitionBy(*KEYS).orderBy("t_dat"))
    agg = bought.withColumn("gap", gap).groupBy(*KEYS).agg(
        F.min("days_ago").alias("last"), count_if(D <= 28).alias("n28"), count_if(D <= 365).alias("n365"), F.count("*").alias("n"),
            sum_if("price", D <= 28).alias("spend"), (count_if(D <= 28) - count_if((D > 28) & (D <= 56))).alias("trend"),
        F.avg(flag(F.col("sales_channel_id") == 2)).alias("online"), F.count_distinct("article_id").alias("articles"),
            F.max("gap").alias("longest"), days_between(F.max("t_dat"), F.min("t_dat")).alias("span"))
    who = once(db["customer"], "customer_id").select(F.col("customer_id").alias("who"), "age", "club_member_status")
    return onto(task, agg).join(who, "who", "left").select(*KEYS,
        decay("last", 30).alias("recency"), log_scaled("n28", 50).alias("n28"), log_scaled("n365", 200).alias("n365"),
            centred("trend", 20).alias("trend"), capped(F.when(F.col("n") > 1, F.col("span") / (F.col("n") - 1)), 90, 90).alias("gap"),
        (F.least(F.greatest(num("last", 9999) / F.greatest(F.coalesce(F.col("longest").cast("double"), num("last", 9999)), F.lit(1.0)),
            F.lit(0.0)), F.lit(3.0)) / 3).alias("overdue"), num("online", 0.5).alias("online"), log_scaled("spend", 5).alias("spend"),
        num(F.col("articles") / F.col("n"), 1).alias("variety"), capped("age", 80, 35).alias("age"),
            flag(F.col("club_member_status") == "ACTIVE").alias("member"), flag(F.col("n").isNull()).alias("is_new"))


def retail_article(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    sold = db["transactions"].select("t_dat", "customer_id", "article_id", "price")
    week, month = D <= 7, D <= 28
    agg = past(task, sold, "article_id", "t_dat").groupBy(*KEYS).agg(
        F.min("days_ago").alias("last"), sum_if("price", week).alias("s7"), sum_if("price", month).alias("s28"),
            sum_if("price", D <= 365).alias("s365"), count_if(week).alias("n7"), count_if(month).alias("n28"),
        (sum_if("price", week) - sum_if("price", (D > 7) & (D <= 14))).alias("trend"),
            F.count_distinct(F.when(month, F.col("customer_id"))).alias("buyers"), F.max("days_ago").alias("age"))
    articles = once(db["article"], "article_id").select("article_id", "product_group_name")
    daily = sold.join(articles, "article_id").groupBy("product_group_name", "article_id", "t_dat").agg(F.sum("price").alias("s"))
    # A cutoff asks for its last 28 days and its own, day by day, so sales are met by group and day and not by cutoff.
    asked = task.join(articles.withColumnRenamed("article_id", "who"),
        "who").where("product_group_name IS NOT NULL").select("product_group_name", "cutoff").distinct()
    asked = asked.withColumn("days_ago", F.explode(F.sequence(F.lit(0), F.lit(28)))).withColumn("day",
        F.date_sub(F.col("cutoff").cast("date"), F.col("days_ago")))
    met = daily.withColumn("day", F.col("t_dat").cast("date")).join(asked, ["product_group_name", "day"]).where("t_dat < cutoff")
    group = met.groupBy("product_group_name", "cutoff").agg(sum_if("s", week).alias("g7"),
        F.count_distinct(F.when(month, F.col("article_id"))).alias("items"))
    full = onto(task, agg).join(articles.withColumnRenamed("article_id", "who"), "who", "left").join(group,
        ["product_group_name", "cutoff"], "left")
    return full.select(*KEYS,
        log_scaled("s7", 5).alias("s7"), log_scaled("s28", 20).alias("s28"), log_scaled("s365", 100).alias("s365"),
            log_scaled("n7", 200).alias("n7"), centred("trend", 2).alias("trend"), decay("last", 10).alias("recency"),
            log_scaled("buyers", 500).alias("buyers"), log_scaled("age", 1000).alias("age"),
        log_scaled("g7", 500).alias("group7"), F.least(ratio("n28", "items", 0), F.lit(1.0)).alias("share"),
            log_scaled("s28", 20).alias("spend"), flag(num("age") < 30).alias("is_new"), flag(F.col("last").isNull()).alias("never"))


def _forum(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    """What both user programs of the forum count."""
    posts = past(task, db["posts"].select("Id", "OwnerUserId", "PostTypeId", "CreationDate"), "OwnerUserId", "CreationDate")
    quarter, votes = D <= 90, db["votes"].select("UserId", "PostId", "VoteTypeId", "CreationDate")
    own = posts.groupBy(*KEYS).agg(F.min("days_ago").alias("last_post"), count_if(quarter).alias("posts90"),
        count_if(D <= 30).alias("posts30"), F.count("*").alias("posts"), count_if(F.col("PostTypeId") == 2).alias("answers"))
    talk = past(task, db["comments"].select("UserId", "CreationDate"), "UserId",
        "CreationDate").groupBy(*KEYS).agg(F.min("days_ago").alias("last_comment"), count_if(quarter).alias("comments90"))
    voted = past(task, votes.select("UserId", "CreationDate"), "UserId",
        "CreationDate").groupBy(*KEYS).agg(F.min("days_ago").alias("last_vote"), count_if(quarter).alias("votes90"))
    edits = past(task, db["postHistory"].select("UserId", "CreationDate"), "UserId",
        "CreationDate").groupBy(*KEYS).agg(count_if(quarter).alias("edits90"))
    got = posts.select(*KEYS, "Id").join(votes.where("VoteTypeId = 2").select(F.col("PostId").alias("Id"),
        F.col("CreationDate").alias("at")), "Id").where("at < cutoff").groupBy(*KEYS).agg(F.count("*").alias("received"))
    badges = past(task, db["badges"].select("UserId", "Class", "Date"), "UserId", "Date").groupBy(*KEYS).agg(F.count("*").alias("badges"),
        count_if(quarter).alias("badges90"), count_if(F.col("Class") == 1).alias("gold"))
    users = once(db["users"], "Id").select(F.col("Id").alias("who"), F.col("CreationDate").alias("joined"))
    return onto(task, own, talk, voted, edits, got, badges).join(users, "who", "left").withColumn("age",
        F.greatest(days_between("cutoff", "joined"), F.lit(0)))


def _nearest(*days: str) -> Column:
    return F.exp(-F.least(*[num(d, 9999) for d in days]) / 65)


def forum_user(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    return _forum(task, db).select(*KEYS,
        _nearest("last_post", "last_comment", "last_vote").alias("recency"), decay("last_post", 87).alias("post_recency"),
            log_scaled(num("posts90") + num("comments90") + num("votes90"), 50).alias("active90"),
            log_scaled("posts90", 30).alias("posts90"), flag(num("posts30") > 0).alias("posted"),
        log_scaled("posts", 500).alias("posts"), ratio("answers", "posts", 0).alias("answers"), log_scaled("badges", 200).alias("badges"),
            log_scaled("age", 3650).alias("age"), log_scaled("edits90", 50).alias("edits90"),
            log_scaled("received", 5000).alias("received"), log_scaled("votes90", 200).alias("votes90"))


def forum_badge(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    return _forum(task, db).select(*KEYS,
        _nearest("last_post", "last_comment").alias("recency"), log_scaled(num("posts90") + num("comments90"), 50).alias("active90"),
            flag(num("posts30") > 0).alias("posted"), capped("badges90", 5, 0).alias("momentum"),
            log_scaled("badges", 200).alias("badges"), flag(num("gold") > 0).alias("gold"),
        log_scaled("received", 5000).alias("received"), log_scaled("posts", 500).alias("posts"), log_scaled("age", 3650).alias("age"),
            log_scaled("edits90", 50).alias("edits90"), log_scaled("votes90", 200).alias("votes90"),
            log_scaled("comments90", 50).alias("comments90"))


def forum_post(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    posts, up = db["posts"].select("Id", "PostTypeId", "OwnerUserId", "ParentId", "CreationDate"), F.col("VoteTypeId") == 2
    votes = db["votes"].select("PostId", "VoteTypeId", "CreationDate")
    own = past(task, posts, "Id", "CreationDate").select(*KEYS, "PostTypeId", "OwnerUserId", F.col("days_ago").alias("age"))
    got = past(task, votes, "PostId", "CreationDate").groupBy(*KEYS).agg(count_if(up & (D <= 90)).alias("up90"), count_if(up).alias("up"),
        count_if(F.col("VoteTypeId") == 3).alias("down"), (count_if(up & (D <= 30)) - count_if(up & (D > 30) & (D <= 60))).alias("trend"))
    talk = past(task, db["comments"].select("PostId", "CreationDate"), "PostId",
        "CreationDate").groupBy(*KEYS).agg(F.count("*").alias("comments"))
    edits = past(task, db["postHistory"].select("PostId", "CreationDate"), "PostId",
        "CreationDate").groupBy(*KEYS).agg(F.count("*").alias("edits"))
    on = votes.select(F.col("PostId").alias("Id"), "VoteTypeId", F.col("CreationDate").alias("at"))
    # An owner's votes are counted once for each cutoff, however many of the owner's posts are asked for.
    owners = own.where("OwnerUserId IS NOT NULL").select(F.col("OwnerUserId").alias("who"), "cutoff").distinct()
    fame = past(owners, posts.select("Id", "OwnerUserId", "CreationDate"), "OwnerUserId", "CreationDate").select(*KEYS,
        "Id").join(on.where("VoteTypeId = 2"), "Id").where("at < cutoff").groupBy(
        *KEYS).agg(F.count("*").alias("fame")).withColumnRenamed("who", "OwnerUserId")
    asked = own.where("PostTypeId = 1").select(*KEYS)
    solved = past(asked, posts.select("Id", "ParentId", "CreationDate"), "ParentId", "CreationDate").select(*KEYS, "Id").join(on,
        "Id").where("at < cutoff").groupBy(*KEYS).agg(F.max(flag(F.col("VoteTypeId") == 1)).alias("solved"))
    full = onto(task, own, got, talk, edits, solved).join(fame, ["OwnerUserId", "cutoff"], "left")
    return full.select(*KEYS,
        log_scaled("up90", 50).alias("up90"), log_scaled("up", 500).alias("up"), F.least(ratio("up", "age", 0), F.lit(1.0)).alias("speed"),
            centred("trend", 10).alias("trend"), ratio("up", num("up") + num("down"), 0.5).alias("approval"),
            decay("age", 260, 0).alias("fresh"), log_scaled("comments", 50).alias("comments"),
        flag(F.col("PostTypeId") == 2).alias("answer"), log_scaled(F.greatest(num("age"), F.lit(0.0)), 3650).alias("age"),
            log_scaled("fame", 10000).alias("fame"), num("solved").alias("solved"), log_scaled("edits", 30).alias("edits"))


def _reviews(task: DataFrame, db: dict[str, DataFrame], key: str) -> DataFrame:
    """Earlier reviews with their product. The product is looked up before reviews meet the cutoffs, which multiply them."""
    reviews = db["review"].select("review_time", "customer_id", "product_id", "rating", "verified")
    goods = once(db["product"], "product_id").select("product_id", "price", "category")
    return past(task, reviews.join(spread(goods), "product_id", "left"), key, "review_time")


def latest_of(name: str) -> Column:
    """Whether a fact is the latest of its label row with this value; nulls never are. To count such facts is to count distinct
    values, but rows that are dealt by entity stay where they are: several distinct counts would multiply and deal them anew."""
    first = F.row_number().over(Window.partitionBy(*KEYS, name).orderBy("days_ago")) == 1
    return first & F.col(name).isNotNull()


def reviews_customer(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    price, quarter = F.col("price"), D <= 90
    agg = _reviews(task, db, "customer_id").withColumns({"new_product": latest_of("product_id"), "new_category": latest_of("category")}).groupBy(*KEYS).agg(
        F.min("days_ago").alias("last"), count_if(D <= 30).alias("n30"), count_if(quarter).alias("n90"), F.count("*").alias("n"),
            F.avg("rating").alias("rating"), F.stddev_pop("rating").alias("spread"), count_if(F.col("rating") <= 2).alias("low"),
            F.avg(flag(F.col("verified"))).alias("verified"),
        avg_if(price, price > 0).alias("price"), sum_if(price, (price > 0) & (D <= 365)).alias("spend1"),
            sum_if(price, price > 0).alias("spend"), count_if(F.col("new_product")).alias("products"),
            count_if(F.col("new_category")).alias("categories"), (count_if(quarter) - count_if((D > 90) & (D <= 180))).alias("trend"))
    return onto(task, agg).select(*KEYS,
        decay("last", 87).alias("recency"), log_scaled("n30", 20).alias("n30"), log_scaled("n90", 30).alias("n90"),
            log_scaled("n", 500).alias("n"), rating("rating").alias("rating"), capped("spread", 2, 0).alias("spread"),
            ratio("low", "n", 0).alias("low"), num("verified", 0.5).alias("verified"), log_scaled("price", 500).alias("price"),
        log_scaled("spend1", 5000).alias("spend1"), log_scaled("spend", 10000).alias("spend"),
            log_scaled("products", 200).alias("products"), log_scaled("categories", 50).alias("categories"),
            centred("trend", 20).alias("trend"), flag(F.col("n").isNull()).alias("is_new"))


def reviews_product(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    year = D <= 365
    agg = _reviews(task, db, "product_id").withColumn("new_customer", latest_of("customer_id")).groupBy(*KEYS).agg(
        F.min("days_ago").alias("last"), count_if(D <= 90).alias("n90"), F.count("*").alias("n"), F.avg("rating").alias("rating"),
            F.stddev_pop("rating").alias("spread"), F.avg(flag(F.col("verified"))).alias("verified"),
            count_if(F.col("new_customer")).alias("people"), count_if(F.col("new_customer") & year).alias("people1"),
        sum_if("price", year).alias("revenue"), F.max("days_ago").alias("age"),
            (count_if(D <= 30) - count_if((D > 30) & (D <= 60))).alias("trend30"),
            (count_if(D <= 90) - count_if((D > 90) & (D <= 180))).alias("trend90"))
    goods = once(db["product"], "product_id").select(F.col("product_id").alias("who"), F.col("price").alias("now"))
    return onto(task, agg).join(spread(goods), "who", "left").select(*KEYS,
        decay("last", 87).alias("recency"), log_scaled("n90", 30).alias("n90"), log_scaled("n", 1000).alias("n"),
            rating("rating").alias("rating"), capped("spread", 2, 0).alias("spread"), num("verified", 0.5).alias("verified"),
            log_scaled("people", 500).alias("people"), log_scaled("people1", 200).alias("people1"),
        log_scaled("now", 500).alias("price"), log_scaled("revenue", 50000).alias("revenue"), log_scaled("age", 2000).alias("age"),
            centred("trend30", 10).alias("trend30"), centred("trend90", 20).alias("trend90"), flag(F.col("n").isNull()).alias("is_new"))


def invited_user(task: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
    status = F.col("status")
    went, asked = status.isin("yes", "maybe"), status == "invited"
    agg = past(task, db["event_attendees"].select("user_id", "status", "start_time"), "user_id", "start_time").groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min(F.when(went, F.col("days_ago"))).alias("last"),
            F.min(F.when(asked, F.col("days_ago"))).alias("last_asked"), count_if(went & (D <= 7)).alias("w7"),
            count_if(went & (D <= 14)).alias("w14"), count_if(went & (D <= 90)).alias("w90"),
            (count_if(went & (D <= 7)) - count_if(went & (D > 7) & (D <= 14))).alias("trend"),
        count_if(asked & (D <= 7)).alias("a7"), count_if(asked & (D <= 90)).alias("a90"), count_if(status == "yes").alias("yes"),
            count_if(status.isin("yes", "maybe", "no")).alias("answered"))
    invited = F.col("invited") == 1
    share = lambda c: F.avg(F.when(invited & (F.col(c) == 1), 1.0).when(invited, 0.0))
    liked = past(task, db["event_interest"].select(F.col("user").alias("person"), "invited", "interested", "not_interested", "timestamp"),
        "person", "timestamp").groupBy(*KEYS).agg(F.count("*").alias("m"), share("interested").alias("interest"),
        share("not_interested").alias("ignored"))
    friends = db["user_friends"].groupBy(F.col("user").alias("who")).agg(F.count("*").alias("friends"))
    # One row a user, should a profile be stored twice.
    joined = db["users"].groupBy(F.col("user_id").alias("who")).agg(F.min("joinedAt").alias("joined"))
    return onto(task, agg, liked, friends, joined).select(*KEYS,
        decay("last", 20).alias("recency"), decay("last_asked", 20).alias("asked_recency"), log_scaled("w7", 30).alias("w7"),
            log_scaled("w14", 50).alias("w14"), log_scaled("w90", 200).alias("w90"), centred("trend", 10).alias("trend"),
            ratio("yes", "answered", 0.5).alias("yes_rate"), log_scaled("a7", 30).alias("a7"), log_scaled("a90", 200).alias("a90"),
        num("interest", 0.3).alias("interest"), num("ignored", 0.1).alias("ignored"), log_scaled("friends", 5000).alias("friends"),
            log_scaled(F.greatest(num(days_between("cutoff", "joined")), F.lit(0.0)), 3650).alias("age"),
            flag(F.col("n").isNull() & F.col("m").isNull()).alias("is_new"))


@dataclass(frozen=True)
class Program:
    """A program and the columns of its label table."""

    features: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    entity: str
    time: str = "timestamp"

    def __call__(self, labels: DataFrame, db: dict[str, DataFrame]) -> DataFrame:
        """Features for each distinct (time, entity) of the label rows, under the label table's own names."""
        task = labels.select(F.col(self.entity).alias("who"), F.col(self.time)
            .alias("cutoff")).where("who IS NOT NULL AND cutoff IS NOT NULL").distinct()
        return self.features(task, db).withColumnsRenamed({"who": self.entity, "cutoff": self.time})

    def vectors(self, labels: DataFrame, db: dict[str, DataFrame], node: str = "node_id", fit_on: Column | None = None) -> DataFrame:
        """(node, features...) of every label row: one program row for each, missing and non-finite values 0, each feature
        less its mean and over its deviation over all label rows, or over those that fit_on tells."""
        rows = dedup_first(self(labels, db), [self.entity, self.time])
        names = [c for c in rows.columns if c not in (self.entity, self.time)]
        kept = [c for c in labels.columns if c not in names]
        # Statistics and rows are both read from one stored table: the program runs once.
        met = materialise(labels.select(*kept).join(spread(rows), [self.entity, self.time], "left"), "features")
        return zscored(met, names, fit_on).select(node, *[F.col(c).cast("float").alias(c) for c in names])


#: Task to program, by domain.
PROGRAMS = {
    **{("racing", t): Program(racing_driver, "driverId", "date") for t in ("driver-position", "driver-dnf", "driver-top3")},
    **{("trials", t): Program(trial_study, "nct_id") for t in ("study-outcome", "study-adverse")},
    ("trials", "site-success"): Program(trial_site, "facility_id"),
    ("ads", "ad-ctr"): Program(ads_ad, "AdID"),
    **{("ads", t): Program(ads_user, "UserID") for t in ("user-visits", "user-clicks")},
    ("retail", "user-churn"): Program(retail_customer, "customer_id"),
    ("retail", "item-sales"): Program(retail_article, "article_id"),
    ("forum", "user-engagement"): Program(forum_user, "OwnerUserId"),
    ("forum", "post-votes"): Program(forum_post, "PostId"),
    ("forum", "user-badge"): Program(forum_badge, "UserId"),
    **{("reviews", t): Program(reviews_customer, "customer_id") for t in ("user-churn", "user-ltv")},
    **{("reviews", t): Program(reviews_product, "product_id") for t in ("item-churn", "item-ltv")},
    **{("invitations", t): Program(invited_user, "user") for t in ("user-attendance", "user-repeat", "user-ignore")},
}
