"""The two recurring jobs as one run each: threat table update, and collection of training texts.

Counters ride on the writes: a step's rows are observed while they are written, and
no step is computed again for its counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import quotes
from ..operators.ids import row_numbers
from ..operators.joins import lookup_join
from ..session import cut
from ..sources import html, tables
from . import curation, intel, policy

ARTICLE, DOMAIN_LIST, DOMAIN_PAGE, MANUAL = "article", "domain_list", "domain_page", "manual"


def observed(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, dict]:
    """The rows, written once, and the counters of that write."""
    watch = Observation(name)
    rows = cut(df.observe(watch, *counts))
    return rows, watch.get


@dataclass
class IntelUpdate:
    domains: DataFrame  # the whole new table
    new_domains: DataFrame
    templates: DataFrame
    new_templates: DataFrame
    report: DataFrame  # (source, articles, domains, texts, errors)
    counters: dict[str, int] = field(default_factory=dict)


def crawl_results(crawled: DataFrame, mode: str = "depth") -> tuple[DataFrame, DataFrame]:
    """Sightings and texts of stored pages ``crawled(source, source_ord, kind, page_id, url, content)``.

    An article gives the domains its warnings name and its quotes; a list gives its
    domains; a submission its domains, its text and its quotes.
    """
    kind = lambda k: crawled.filter(F.col("kind") == k)
    place = crawled.select("page_id", "source", "source_ord")
    articles = kind(ARTICLE).select("page_id", "url", F.col("content").alias("html"))
    blocks = cut(html.paragraphs(articles, mode, outside=False))
    warned = intel.warned_domains(blocks).select("page_id", F.col("url").alias("source_url"), "domain", F.col("pos").cast("long").alias("pos"), "evidence")
    quoted = html.quotes_of(blocks).select("page_id", F.col("url").alias("source_url"), F.col("pos").cast("long").alias("pos"), F.col("quote_pos").alias("part"), F.col("quote").alias("text"))
    lists = kind(DOMAIN_LIST).select(F.col("page_id").cast("string").alias("source"), F.col("url").alias("source_url"), "content")
    listed = tables.domain_list(lists).select(F.col("source").cast("long").alias("page_id"), "source_url", "domain", F.col("ord")[0].cast("long").alias("pos"), F.lit("listed").alias("evidence"))
    pages = kind(DOMAIN_PAGE).select("page_id", "url", F.col("content").alias("html"))
    found = intel.listed_page_domains(pages).select("page_id", F.col("url").alias("source_url"), "domain", F.lit(0).cast("long").alias("pos"), F.lit("listed").alias("evidence"))
    told, parts = intel.submissions(kind(MANUAL).select(F.col("page_id").alias("ord"), F.col("content").alias("text"), F.col("url").alias("source_url")))
    sent = told.select(F.col("ord").alias("page_id"), "source_url", "domain", F.lit(0).cast("long").alias("pos"), "evidence")
    texts = quoted.unionByName(parts.select(F.col("ord").alias("page_id"), "source_url", F.lit(0).cast("long").alias("pos"), "part", "text"))
    seen = warned.unionByName(listed).unionByName(found).unionByName(sent).join(place, "page_id")
    return seen.withColumn("ord", F.struct("page_id", "pos")).drop("page_id", "pos"), texts.join(place, "page_id")


def update_intel(
    crawled: DataFrame,
    domains: DataFrame,
    templates: DataFrame,
    allowlist: DataFrame,
    rejected_domains: DataFrame,
    rejected_templates: DataFrame,
    today: str,
    mode: str = "depth",
) -> IntelUpdate:
    """New threat tables from one crawl, ``crawled(source, source_ord, kind, page_id, url, content, error)``.

    A page with an ``error`` counts for its source's errors and gives nothing else.
    Domains and templates are added in the order of sources, pages and places in them.
    """
    pages, counted = observed(crawled, "crawl", F.count_if(F.col("error").isNull()).alias("articles"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    read = pages.filter("error IS NULL").drop("error")
    seen, texts = crawl_results(read, mode)
    seen, texts = cut(seen), cut(texts)
    outcomes = intel.domain_outcomes(intel.first_sightings(seen), domains, allowlist, rejected_domains)
    is_ = lambda kind: F.count_if(F.col("outcome") == kind)
    judged, of_domains = observed(outcomes, "domains", is_("new").alias("new_domains"), is_("allowed").alias("skipped_allowed"), is_("rejected").alias("barred_domains"))
    new_domains = judged.filter("outcome = 'new'").select("domain", "source", "source_url", F.lit(today).alias("first_seen"), "evidence")
    ordered = row_numbers(texts, [F.col(c) for c in ("source_ord", "source", "page_id", "pos", "part")], column="ord")
    fresh, again = intel.merge_templates(ordered, templates, rejected_templates, today)
    new_templates, of_templates = observed(fresh, "templates", F.count(F.lit(1)).alias("new_templates"))
    _, of_barred = observed(again.select("ord"), "barred", F.count(F.lit(1)).alias("barred_templates"))
    counters = {**counted, **of_domains, **of_templates, **of_barred}
    counters["skipped_rejected"] = counters.pop("barred_domains") + counters.pop("barred_templates")
    report = intel.source_report(read.select("source"), seen.select("source", "domain"), texts.select("source"), pages.filter("error IS NOT NULL").select("source"))
    columns = new_domains.columns
    table = domains.select(*columns).unionByName(new_domains).orderBy("domain")
    kept = [c for c in new_templates.columns if c in templates.columns]
    return IntelUpdate(table, new_domains, templates.select(*kept).unionByName(new_templates.select(*kept)), new_templates, report, counters)


@dataclass
class Collection:
    candidates: DataFrame  # the new rows only
    report: DataFrame  # (source_name, articles, added, duplicate, name, invalid, errors)
    counters: dict[str, int] = field(default_factory=dict)


def collect_sources(
    pages: DataFrame, robots: DataFrame, existing: DataFrame, known: DataFrame, today: str, cap: int = fv.MAX_NEW_CANDIDATES, mode: str = "depth", vietnamese_only: bool = True
) -> Collection:
    """New candidates from stored pages ``(source_name, source_ord, origin, host, page_id, url, html, error)``.

    A host whose robots file ``robots(host, text)`` bars training is not read and counts
    as one error of its source. Sources are read in order until ``cap`` texts were
    added before one; the first ``cap`` of them become candidates.
    """
    barred = policy.training_policy(robots).filter("NOT allowed").select("host")
    placed = lookup_join(pages, barred.withColumn("barred", F.lit(True)), ["host"], "left").withColumn("barred", F.coalesce("barred", F.lit(False)))
    placed, seen = observed(placed, "pages", F.count_if(F.col("barred")).alias("barred_pages"), F.count_if(~F.col("barred") & F.col("error").isNotNull()).alias("failed_pages"))
    read = placed.filter("NOT barred AND error IS NULL")
    told = html.quotes_of(html.paragraphs(read.select("page_id", "url", "html"), mode, outside=False))
    texts = told.join(read.select("page_id", "source_name", "source_ord", "origin"), "page_id")
    offers = row_numbers(texts, [F.col(c) for c in ("source_ord", "page_id", "pos", "quote_pos")], column="ord")
    offers = offers.select("ord", F.col("quote").alias("text"), "source_name", "source_ord", "origin", F.lit("public_post").alias("source"), F.col("url").alias("source_url"))
    kinds = ("added", "duplicate", "name", "invalid")
    outcomes, counters = observed(curation.collect_outcomes(offers, known, vietnamese_only), "offers", *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    sources = placed.groupBy("source_name", "source_ord").agg(
        F.count_if(~F.col("barred") & F.col("error").isNull()).alias("articles"),
        (F.count_if(~F.col("barred") & F.col("error").isNotNull()) + F.count_distinct(F.when(F.col("barred"), F.col("host")))).alias("errors"),
    )
    within = curation.within_cap(outcomes.select("source_ord", "outcome", "source_name"), cap)
    unread = outcomes.join(within.select("source_ord").distinct(), "source_ord", "left_anti").agg(F.min("source_ord")).first()[0]  # the first source left out
    if unread is not None:
        sources = sources.filter(F.col("source_ord") < unread)
    report = sources.join(curation.collection_report(within, ["source_name"]), "source_name", "left").na.fill(0)
    candidates = curation.new_candidates(outcomes, existing, today, cap)
    return Collection(candidates, report.select("source_name", "articles", *kinds, "errors"), {**seen, **counters})
