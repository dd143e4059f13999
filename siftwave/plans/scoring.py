"""Message scoring and link inspection as lazy plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decision
from ..functions import fixed_values as fv
from ..functions.similarity import shingles
from ..functions.text import is_blank, mask, message_error, normalize, surely_too_long
from ..functions.urls import link_facts, noisy_or, suffixes
from ..operators.joins import domain_set, is_small, join_groups, lookup_join
from ..operators.similarity import best_template
from ..session import cut


@dataclass
class Intel:
    """Threat tables: ``blocked(domain)``, ``official(domain)``, ``templates(id, text)``."""

    blocked: DataFrame | None = None
    official: DataFrame | None = None
    templates: DataFrame | None = None


def prepared(messages: DataFrame) -> DataFrame:
    """``(msg_id, error, normalized)`` of ``messages(msg_id, text)``; texts that are clearly too long are not normalised."""
    normal = messages.select("msg_id", "text", F.when(~surely_too_long(F.col("text")), normalize(F.col("text"))).alias("normalized"))
    skipped = F.when(F.col("normalized").isNull(), F.lit("classification.text_too_long"))
    return normal.select(
        "msg_id",
        F.coalesce(message_error(F.col("text"), F.col("normalized")), skipped).alias("error"),
        "normalized",
    )


def _written(rows: DataFrame) -> DataFrame:
    """Rows of a batch that several steps read, written once."""
    return rows if rows.isStreaming else cut(rows)


def _facts(base: DataFrame, intel: Intel) -> DataFrame:
    """``(msg_id, error, links, masked)`` of prepared messages, found in one pass over the texts; masked where templates need it."""
    fine = F.col("error").isNull()
    no_links = F.array().cast("array<struct<url:string,host:string,reasons:array<string>,brand:boolean>>")
    links = F.when(fine, link_facts(F.col("normalized"))).otherwise(no_links)
    masked = F.lit(None).cast("string") if intel.templates is None else F.when(fine, mask(F.col("normalized")))
    return _written(base.select("msg_id", "error", links.alias("links"), masked.alias("masked")))


def _listed(links: DataFrame, intel: Intel) -> DataFrame | None:
    """``(msg_id, blocked array, official array)``: listed hosts per message, only messages that have any.

    Both lists are looked up in one pass over the exploded parents of the hosts.
    """
    sides = []
    if intel.blocked is not None:
        sides.append(domain_set(intel.blocked).withColumn("kind", F.lit("blocked")))
    if intel.official is not None:
        sides.append(domain_set(intel.official).withColumn("kind", F.lit("official")))
    if not sides:
        return None
    lists = _written(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))
    hosts = links.select("msg_id", F.explode(F.array_distinct(F.col("links.host"))).alias("host")).filter("host is not null")
    parents = hosts.select("msg_id", "host", F.explode(suffixes(F.col("host"))).alias("domain"))
    hits = lookup_join(parents, lists, ["domain"])

    def named(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("host"))).alias(kind)

    return hits.groupBy("msg_id").agg(named("blocked"), named("official"))


def _with_threats(links: DataFrame, intel: Intel) -> DataFrame:
    """Add ``blocked_hosts`` (first seen first), ``brand_links`` and ``url_reasons``."""
    none = F.array().cast("array<string>")
    listed = _listed(links, intel)
    if listed is None:
        joined = links.withColumn("blocked", none).withColumn("official", none)
    else:
        joined = links.join(listed, "msg_id", "left")
        joined = joined.withColumn("blocked", F.coalesce("blocked", none)).withColumn("official", F.coalesce("official", none))
    hosts = F.array_distinct(F.filter(F.col("links.host"), lambda h: h.isNotNull()))
    blocked_hosts = F.filter(hosts, lambda h: F.array_contains(F.col("blocked"), h))
    hit = F.filter(
        F.col("links"),
        lambda k: k["brand"]
        & ~F.array_contains(F.col("blocked"), k["host"])
        & ~F.array_contains(F.col("official"), k["host"]),
    )
    brands = F.array_distinct(F.transform(hit, lambda k: k["url"]))
    by_rule = F.flatten(F.col("links.reasons"))
    by_brand = F.transform(F.col("brand_links"), lambda _: F.lit("url_brand_impersonation"))
    return (
        joined.withColumn("blocked_hosts", blocked_hosts)
        .withColumn("brand_links", brands)
        .withColumn("url_reasons", F.array_distinct(F.concat(by_rule, by_brand)))
        .drop("blocked", "official")
    )


def url_findings(messages: DataFrame) -> DataFrame:
    """``(msg_id, pos, url, reason)``: one row per rule a link breaks, in text order."""
    links = messages.select("msg_id", F.posexplode(link_facts(normalize(F.col("text")))).alias("pos", "k"))
    return links.select("msg_id", "pos", F.col("k.url").alias("url"), F.explode("k.reasons").alias("reason"))


def threat_match(messages: DataFrame, intel: Intel, min_coverage: float = fv.MIN_TEMPLATE_COVERAGE) -> DataFrame:
    """Per message: blocked hosts, brand-imitating links, link reasons and best template."""
    facts = _facts(prepared(messages).filter("error is null"), intel)
    matched = _with_threats(facts.select("msg_id", "links"), intel).drop("links")
    return _join_template(matched, facts, intel, min_coverage)


def _join_template(matched: DataFrame, facts: DataFrame, intel: Intel, min_coverage: float) -> DataFrame:
    if intel.templates is None:
        return matched.withColumn("tpl_id", F.lit(None).cast("string")).withColumn("coverage", F.lit(None).cast("double"))
    sets = facts.filter("error is null").select("msg_id", shingles(F.col("masked")).alias("shingles"))
    known = intel.templates.filter(F.length("text") > 0).select(F.col("id").alias("tpl_id"), shingles(F.col("text")).alias("shingles"))
    return matched.join(best_template(sets, known, min_coverage), "msg_id", "left")


def score_messages(
    messages: DataFrame,
    intel: Intel,
    predictions: DataFrame | None = None,
    threshold: float = fv.SCAM_THRESHOLD,
    min_coverage: float = fv.MIN_TEMPLATE_COVERAGE,
    findings: DataFrame | None = None,
) -> DataFrame:
    """``(msg_id, status, label, confidence, reasons)`` of ``messages(msg_id, text)``.

    ``predictions(msg_id, normal, spam, scam)`` come from a model run elsewhere;
    without a row for a message only its links can decide. ``findings(msg_id,
    reason)`` adds link findings of an own inspector. The text itself is never
    shuffled: what meets on ``msg_id`` are short arrays and numbers.
    """
    none = F.array().cast("array<string>")
    facts = _facts(prepared(messages), intel)
    matched = _with_threats(facts.select("msg_id", "error", "links"), intel).drop("links", "brand_links")
    joined = _join_template(matched, facts, intel, min_coverage)
    if findings is not None:
        extra = findings.groupBy("msg_id").agg(F.sort_array(F.collect_set("reason")).alias("extra"))
        joined = joined.join(extra, "msg_id", "left").withColumn(
            "url_reasons", F.array_distinct(F.concat("url_reasons", F.coalesce("extra", none)))
        )
    if predictions is None:
        joined = joined.withColumn("prediction", F.lit(None).cast(decision.PROBABILITIES))
    else:
        shares = predictions.select("msg_id", F.struct("normal", "spam", "scam").alias("prediction"))
        joined = joined.join(shares, "msg_id", "left")
    result = decision.classify(
        F.col("error"), F.col("prediction"), F.col("url_reasons"), F.size("blocked_hosts") > 0, F.col("coverage"), threshold
    )
    scored = joined.select("msg_id", "error", result.alias("result"))
    return scored.select(
        "msg_id",
        decision.status(F.col("error"), F.col("result")).alias("status"),
        F.col("result.label").alias("label"),
        F.col("result.confidence").alias("confidence"),
        F.col("result.reasons").alias("reasons"),
    )


def messages_for_model(messages: DataFrame, intel: Intel, threshold: float = fv.SCAM_THRESHOLD) -> DataFrame:
    """``(msg_id, masked)``: only the messages a model still has to judge."""
    undecided = score_messages(messages, intel, None, threshold).filter(
        (F.col("status") == "classification.model_unavailable")
        | ((F.col("status") == "ok") & ~F.exists("reasons", lambda r: r.isin("url_blocklisted", "matches_known_scam_template")))
    )
    masked = prepared(messages).filter("error is null").select("msg_id", mask(F.col("normalized")).alias("masked"))
    return masked.join(undecided.select("msg_id"), "msg_id", "left_semi")


def first_available(primary: DataFrame | None, fallback: DataFrame | None) -> DataFrame | None:
    """Predictions of the first model whose output table exists (a job-level choice)."""
    return primary if primary is not None else fallback


def fill_predictions(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary predictions, completed row by row with the fallback model's."""
    a = primary.select("msg_id", F.struct("normal", "spam", "scam").alias("p"))
    b = fallback.select("msg_id", F.struct("normal", "spam", "scam").alias("q"))
    return a.join(b, "msg_id", "full").select("msg_id", F.coalesce("p", "q").alias("p")).select("msg_id", "p.*")


def _failed_requests(links: DataFrame) -> DataFrame:
    bad = is_blank(F.col("url")) | (F.length("url") > fv.MAX_LINK_LENGTH)
    totals = links.groupBy("request_id").agg(
        F.count("url").alias("n"), F.max(bad.cast("int")).alias("bad"), F.count("*").alias("rows")
    )
    error = (
        F.when(F.col("n") == 0, F.lit("link_inspection.no_links"))
        .when(F.col("n") > fv.MAX_LINKS_PER_REQUEST, F.lit("link_inspection.too_many_links"))
        .when(F.col("bad") == 1, F.lit("link_inspection.invalid_link"))
    )
    return totals.select("request_id", error.alias("error"), "rows").filter("error is not null")


def request_errors(links: DataFrame) -> DataFrame:
    """``(request_id, error)`` of requests ``links(request_id, url)`` that fail as a whole."""
    return _failed_requests(links).drop("rows")


def inspect_links(links: DataFrame, intel: Intel, threshold: float = fv.SCAM_THRESHOLD) -> DataFrame:
    """``(link_id, url, verdict, reasons)`` of ``links(link_id, url)``; no model involved."""
    keyed = links.select(
        F.col("link_id").alias("msg_id"), "url", link_facts(normalize(F.col("url"))).alias("links")
    )
    matched = _with_threats(_written(keyed), intel)
    blocked = F.size("blocked_hosts") > 0
    found = F.size("url_reasons") > 0
    verdict = (
        F.when(blocked | decision.reaches(noisy_or(F.col("url_reasons")), threshold), F.lit("dangerous"))
        .when(found, F.lit("suspicious"))
        .otherwise(F.lit("safe"))
    )
    listed = F.array_compact(F.array(F.when(blocked, F.lit("url_blocklisted"))))
    return matched.select(
        F.col("msg_id").alias("link_id"),
        "url",
        verdict.alias("verdict"),
        F.array_distinct(F.concat(listed, F.col("url_reasons"))).alias("reasons"),
    )


def inspect_requests(links: DataFrame, intel: Intel, threshold: float = fv.SCAM_THRESHOLD) -> DataFrame:
    """Requests ``links(request_id, pos, url)``: one row per link, or one error row per failed request."""
    failed = _failed_requests(links)
    good = join_groups(links.select("request_id", "pos", "url"), failed.select("request_id", "rows"), ["request_id"], "rows", "left_anti")
    keyed = good.withColumn("link_id", F.struct("request_id", "pos"))
    done = inspect_links(keyed, intel, threshold).select(
        "link_id.request_id", "link_id.pos", "url", "verdict", "reasons", F.lit(None).cast("string").alias("error")
    )
    errors = failed.select(
        "request_id",
        F.lit(None).cast(links.schema["pos"].dataType).alias("pos"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("array<string>").alias("reasons"),
        "error",
    )
    return done.unionByName(errors)


def describe_reasons(df: DataFrame, column: str = "reason", descriptions: DataFrame | None = None) -> DataFrame:
    """Add ``description``; a code without one describes itself."""
    spark = df.sparkSession
    if descriptions is None:
        descriptions = spark.createDataFrame(list(fv.REASON_DESCRIPTIONS.items()), "code string, description string")
    table = descriptions.select(F.col("code").alias(column), "description")
    hinted = F.broadcast(table) if is_small(table) else table
    return df.join(hinted, column, "left").withColumn("description", F.coalesce("description", F.col(column)))
