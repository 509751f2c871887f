"""User activity, allowances and rate audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import india_day

RETENTION_DAYS = 120
DAY_CAP, SITE_CAP = 20, 500


def daily(events: DataFrame) -> DataFrame:
    """user_id, day, visits, focus: per day, the last 120 days of the log. ``events``: user_id, ts, kind (visit or focus), amount."""
    last = events.agg(F.max(F.to_date("ts")).alias("last"))
    x = events.select("user_id", F.to_date("ts").alias("day"), "kind", "amount")
    g = x.groupBy("user_id", "day").agg(F.count_if(F.col("kind") == "visit").alias("visits"), F.coalesce(F.sum(F.when(F.col("kind") == "focus", F.col("amount"))), F.lit(0)).alias("focus"))
    return g.join(F.broadcast(last), F.col("day") > F.date_sub("last", RETENTION_DAYS)).drop("last")  # one row


def streaks(days: DataFrame, today: Column) -> DataFrame:
    """user_id, current, longest, active_today, focus_today, focus_week. A streak is current up to today or yesterday."""
    w = Window.partitionBy("user_id").orderBy("day")
    x = days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    runs = x.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("end"))
    s = runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max(F.when(F.col("end") >= F.date_sub(today, 1), F.col("n"))).alias("current"))
    t = days.groupBy(F.col("user_id").alias("u")).agg(F.max((F.col("day") == today).cast("int")).alias("a"), F.coalesce(F.sum(F.when(F.col("day") == today, F.col("focus"))), F.lit(0)).alias("focus_today"), F.coalesce(F.sum(F.when(F.col("day") > F.date_sub(today, 7), F.col("focus"))), F.lit(0)).alias("focus_week"))
    return s.join(t, F.col("user_id") == F.col("u")).select("user_id", F.coalesce("current", F.lit(0)).alias("current"), "longest", (F.col("a") == 1).alias("active_today"), "focus_today", "focus_week")


def grid(days: DataFrame, today: Column, n: int = 84) -> DataFrame:
    """user_id, day, level of the last ``n`` days: 3 much focus, 2 some focus or four visits, 1 active, 0 not."""
    users = days.select("user_id").distinct()
    cells = users.select(F.col("user_id").alias("u"), F.explode(F.sequence(F.date_sub(today, n - 1), today)).alias("d"))
    x = cells.join(days, (F.col("u") == F.col("user_id")) & (F.col("d") == F.col("day")), "left")
    level = F.when(F.col("focus") >= 50, 3).when((F.col("focus") > 0) | (F.col("visits") >= 4), 2).when(F.col("day").isNotNull(), 1).otherwise(0)
    return x.select(F.col("u").alias("user_id"), F.col("d").alias("day"), level.alias("level"))


def recent_items(visits: DataFrame, most: int = 8) -> DataFrame:
    """user_id, item, ts, place: the last distinct items of each user."""
    g = visits.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item")
    return g.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def saved(toggles: DataFrame) -> DataFrame:
    """user_id, item, ts of what is saved: an odd number of toggles."""
    return toggles.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts")).where("n % 2 = 1").drop("n")


def allowance(requests: DataFrame, user_cap: int = DAY_CAP, site_cap: int = SITE_CAP) -> DataFrame:
    """request_id, day, verdict: each user's first requests of an Indian day within the cap, then the first of those site-wide.

    The site's rank is not taken by one window over a day: requests are counted by minute, and a request's
    rank is the sum of earlier minutes and its place in its own.
    """
    x = requests.select("request_id", "user_id", "ts", india_day(F.col("ts")).alias("day"))
    mine = Window.partitionBy("user_id", "day").orderBy("ts", "request_id")
    x = x.withColumn("mine", F.row_number().over(mine)).withColumn("ok", F.col("mine") <= user_cap).withColumn("minute", F.date_trunc("minute", "ts"))
    per = x.where("ok").groupBy("day", "minute").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("day").alias("d"), F.col("minute").alias("m"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("day", "minute", "ok").orderBy("ts", "request_id"))
    x = x.withColumn("place", place).join(per, (F.col("day") == F.col("d")) & (F.col("minute") == F.col("m")), "left")
    return x.select("request_id", "day", F.when(~F.col("ok"), "user-limit").when(F.col("earlier") + F.col("place") > site_cap, "global-limit").otherwise("ok").alias("verdict"))


def rate_audit(requests: DataFrame, key: str, window: str, limit: int) -> DataFrame:
    """key, start, n, over of each clock-aligned window. Works on a stream with a watermark as on a table."""
    g = requests.groupBy(F.window("ts", window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def unexpired(rows: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Rows younger than ``days``. ``rows`` has ts."""
    return rows.where(F.col("ts") > now - F.make_dt_interval(F.lit(days)))


def shared_answers(asks: DataFrame, now: Column, askers: int = 2, days: int = 3) -> DataFrame:
    """key, n_askers, shared: answers asked for lately; shown to all once enough different users asked."""
    g = unexpired(asks, now, days).groupBy("key").agg(F.countDistinct("user_id").alias("n_askers"))
    return g.withColumn("shared", F.col("n_askers") >= askers)
