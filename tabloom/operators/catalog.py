"""Looking things up in a catalogue: search, expiry, hierarchy, activity and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.lookup import hot_keys, lookup_join
from tabloom.functions.ordered import first_per_group
from tabloom.session import materialize

TTL_HOURS = 6
DAILY_QUOTA = 5
PER_TYPE = 5
TIMELINE = 10
READY = ["COMPLETED", "DEPLOYED"]


def search(
    df: DataFrame, names: Sequence[str], ts: str, text: str | None = None, day: str | None = None
) -> DataFrame:
    """Rows where a name contains the text (any case) or the timestamp falls on the day,
    newest first. Both filters together widen the result."""
    found: Column | None = None
    if text:
        for n in names:
            hit = F.col(n).ilike(f"%{text}%")
            found = hit if found is None else found | hit
    if day:
        # a range on the raw column reaches the scan, a cast of the column would not
        start = F.lit(day).cast("date")
        hit = (F.col(ts) >= start) & (F.col(ts) < F.date_add(start, 1))
        found = hit if found is None else found | hit
    out = df if found is None else df.where(found)
    return out.orderBy(F.col(ts).desc_nulls_last())


def by_status(df: DataFrame, status: str, wanted: Sequence[str], ts: str, limit: int, tie: str) -> DataFrame:
    """The newest ``limit`` rows in one of the wanted states."""
    return df.where(F.col(status).isin(list(wanted))).orderBy(F.col(ts).desc_nulls_last(), F.col(tie)).limit(limit)


def expired(df: DataFrame, ts: str, now: Column, hours: int = TTL_HOURS) -> DataFrame:
    """Rows strictly older than ``hours`` before ``now``."""
    return df.where(F.col(ts) < now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def alive(df: DataFrame, ts: str, now: Column, hours: int = TTL_HOURS) -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def newest(df: DataFrame, ts: str):
    """The latest timestamp, as the clock of a finished data set."""
    return df.agg(F.max(ts)).first()[0]


def empty_parents(parents: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Parents that no child table refers to. Child keys are made distinct first, so a
    parent with very many children costs no more than another."""
    out = parents
    for child, ref in children:
        refs = child.select(F.col(ref).alias("_ref")).where("_ref IS NOT NULL").distinct()
        out = out.join(refs, F.col(key) == F.col("_ref"), "left_anti")
    return out


def breadcrumbs(nodes: DataFrame, id_: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """(id, path): the names and ids from the root down to every node. A parent that does not
    exist ends the path; a cycle is an error.

    Every node holds the piece of its path found so far and the node above that piece. A round
    puts the piece of that node in front, so pieces double and a depth of d takes log2(d)
    rounds. Finished paths are kept apart; a parent of very many children is a hot key.
    """
    step = F.struct(F.col(id_).alias("id"), F.col(name).alias("name"))
    start = materialize(nodes.select(F.col(id_).alias("id"), F.col(parent).alias("up"), F.array(step).alias("path")))
    done, open_ = [start.where(F.col("up").isNull())], start.where(F.col("up").isNotNull())
    while open_.limit(1).count():
        if open_.where(F.exists("path", lambda s: s["id"] == F.col("up"))).limit(1).count():
            raise ValueError("the hierarchy has a cycle")
        pieces = reduce(DataFrame.unionByName, [*done, open_]).select(F.col("id").alias("k"), F.struct("up", "path").alias("v"))
        hot = hot_keys(open_.groupBy("up").agg(F.count(F.lit(1)).alias("w")), "up", "w")
        joined = lookup_join(open_, "up", pieces, "k", "v", small=False, into="_v", hot=hot)
        longer = F.when(F.col("_v").isNull(), F.col("path")).otherwise(F.concat(F.col("_v")["path"], "path"))
        found = materialize(joined.select("id", F.col("_v")["up"].alias("up"), longer.alias("path")))
        done.append(found.where(F.col("up").isNull()))
        open_ = found.where(F.col("up").isNotNull())
    return reduce(DataFrame.unionByName, done).select("id", "path")


def activity_timeline(
    sources: Mapping[str, DataFrame], per_type: int = PER_TYPE, limit: int = TIMELINE
) -> DataFrame:
    """The newest entries over several (title, ts) sources; each gives its newest few."""
    parts = []
    for kind, df in sources.items():
        top = df.select(F.lit(kind).alias("type"), "title", "ts").orderBy(F.col("ts").desc_nulls_last(), "title").limit(per_type)
        parts.append(top)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("ts").desc_nulls_last(), "type", "title").limit(limit)


def daily_quota(df: DataFrame, user: str, ts: str, key: str, quota: int = DAILY_QUOTA) -> DataFrame:
    """Every row with ``accepted``: whether it is among the user's first few of the day.

    The accepted keys are found in two rounds, so that a very busy user-day is cut
    down inside slices first, and come back by the unique key.
    """
    keyed = df.select(F.col(key).alias("_key"), F.col(user).alias("_user"), F.to_date(ts).alias("_day"), F.col(ts).alias("_ts"))
    first = first_per_group(keyed, ["_user", "_day"], [F.col("_ts"), F.col("_key")], quota, F.col("_key"))
    return df.join(first.select("_key"), F.col(key) == F.col("_key"), "left").select(
        *[F.col(c) for c in df.columns], F.col("_key").isNotNull().alias("accepted")
    )
