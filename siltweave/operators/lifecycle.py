"""The state machine of known issues (KI3, STM6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legal steps (fixed values); states without an entry are final.
STEPS = {"open": ("in_progress", "open_systemic", "wontfix"), "in_progress": ("resolved", "wontfix")}


def last_state(events: DataFrame, issue: str, ts: str, state: str) -> DataFrame:
    """(issue, state, n_steps): illegal transitions are ignored.

    An issue can take at most as many legal steps as the machine has levels, so per state only the
    first event matters after another: events are cut to the earliest of each kind after each legal
    predecessor, which bounds what one task holds however many events an issue has.
    """
    e = events.select(F.col(issue).alias("issue"), F.col(ts).alias("ts"), F.col(state).alias("s"))
    first = e.where(F.col("s").isin(*STEPS["open"])).groupBy("issue").agg(F.min(F.struct("ts", "s")).alias("a"))
    later = e.join(first.where("a.s = 'in_progress'"), "issue").where(F.col("s").isin(*STEPS["in_progress"]) & (F.struct("ts", "s") > F.struct("a.ts", "a.s")))
    second = later.groupBy("issue").agg(F.min(F.struct("ts", "s")).alias("b"))
    out = e.select("issue").distinct().join(first, "issue", "left").join(second, "issue", "left")
    return out.select("issue", F.coalesce("b.s", "a.s", F.lit("open")).alias("state"), (F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")).alias("n_steps"))
