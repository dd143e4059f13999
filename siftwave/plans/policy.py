"""May the texts of a host be used for training? Decision from stored robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def signal_forbids(text: Column) -> Column:
    """Some Content-Signal line ends up with ``ai-train=no``."""

    def says_no(line: Column) -> Column:
        parts = F.transform(F.split(line, ","), lambda p: F.lower(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")))
        named = F.filter(parts, lambda p: p.startswith("ai-train="))
        return F.coalesce(F.try_element_at(named, F.lit(-1)) == "ai-train=no", F.lit(False))

    return F.exists(F.regexp_extract_all(text, F.lit(fv.CONTENT_SIGNAL), F.lit(1)), says_no)


def barred_agents(text: Column) -> Column:
    """Training agents that a group with ``Disallow: /`` names, sorted.

    One pass over the directives of a file: agent lines in a row open one group,
    any other directive ends the list of agents but not the group.
    """
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(fv.ROBOTS_DIRECTIVE))
    steps = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, fv.ROBOTS_DIRECTIVE, 1)).alias("key"),
            F.trim(F.regexp_extract(x, fv.ROBOTS_DIRECTIVE, 2)).alias("value"),
        ),
    )
    names = F.array().cast("array<string>")
    known = F.array(*[F.lit(a) for a in fv.AI_TRAINING_AGENTS])

    def state(agents: Column, reading: Column, barred: Column) -> Column:
        return F.struct(agents.alias("agents"), reading.alias("reading"), barred.alias("barred"))

    def step(acc: Column, line: Column) -> Column:
        agent = F.array(F.lower(line["value"]))
        opened = F.when(acc["reading"], F.concat(acc["agents"], agent)).otherwise(agent)
        closes = (line["key"] == "disallow") & (line["value"] == "/")
        more = F.when(closes, F.array_union(acc["barred"], F.array_intersect(acc["agents"], known))).otherwise(acc["barred"])
        return F.when(line["key"] == "user-agent", state(opened, F.lit(True), acc["barred"])).otherwise(
            state(acc["agents"], F.lit(False), more)
        )

    return F.sort_array(F.aggregate(steps, state(names, F.lit(False), names), step, lambda acc: acc["barred"]))


def training_policy(robots: DataFrame) -> DataFrame:
    """``(host, allowed, reason, agents)`` of ``robots(host, text)``; a missing file allows."""
    text = F.coalesce("text", F.lit(""))
    judged = robots.select("host", signal_forbids(text).alias("signal"), barred_agents(text).alias("agents"))
    reason = (
        F.when(F.col("signal"), "content_signal").when(F.size("agents") > 0, "agents_barred").otherwise("unrestricted")
    )
    named = F.when(F.col("signal"), F.array().cast("array<string>")).otherwise(F.col("agents"))
    return judged.select("host", (reason == "unrestricted").alias("allowed"), reason.alias("reason"), named.alias("agents"))
