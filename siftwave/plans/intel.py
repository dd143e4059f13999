"""Keeping the threat tables up to date: sightings, domain merge, template merge, rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.similarity import fingerprint, fingerprint_of, shingles, tokens
from ..functions.text import contains_keyword, evidence_excerpt, has_vietnamese_letter, is_warning, quotes, stripped, template_text
from ..functions.urls import domain, domains, suffixes
from ..operators.ids import assign_ids
from ..operators.joins import first_by, listed_keys, lookup_join
from ..operators.similarity import fingerprint_matches, greedy_dedup, near_sets
from ..session import cut
from ..sources.html import page_text


def page_host(url: Column) -> Column:
    """Domain form of the host of a page address."""
    return domain(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def article_links(items: DataFrame, order: str = "pos", empty_links_first: bool = False) -> DataFrame:
    """Feed items to read: ``items(source, max_items, keywords, pos, title, link, summary)``.

    The threat crawl cuts to ``max_items`` and then drops items without a link;
    ``empty_links_first`` drops them before the cut, as the training crawl does.
    """
    text = F.concat_ws(" ", "title", "summary")
    matching = items.filter(contains_keyword(text, F.col("keywords")))
    if empty_links_first:
        matching = matching.filter(F.col("link") != "")
    return max_items(matching, "source", "max_items", order).filter(F.col("link") != "")


def max_items(df: DataFrame, group: str, limit: str, order: str) -> DataFrame:
    """First ``limit`` rows per group.

    The largest limit is read first, one number. With it as a literal every task
    cuts its groups before the shuffle, so a hot group sends a few rows per task.
    """
    largest = df.agg(F.coalesce(F.max(limit), F.lit(0)).alias("n")).first()["n"]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = df.withColumn("_rank", rank).filter(F.col("_rank") <= F.lit(largest))
    return ranked.filter(F.col("_rank") <= F.col(limit)).drop("_rank")


def warned_domains(paragraph_rows: DataFrame) -> DataFrame:
    """``(page_id, url, domain, pos, evidence)``: domains named in a warning, first paragraph wins.

    The page's own host is left out. Input ``(page_id, url, pos, paragraph)``.
    """
    named = paragraph_rows.filter(is_warning(F.col("paragraph"))).select(
        "page_id", "url", "pos", "paragraph", F.explode(domains(F.col("paragraph"))).alias("domain")
    )
    foreign = named.filter(F.col("domain") != F.coalesce(page_host(F.col("url")), F.lit("")))
    first = first_by(foreign.select("page_id", "url", "domain", "pos", "paragraph"), ["page_id", "domain"], [F.col("pos")])
    return first.select("page_id", "url", "domain", "pos", evidence_excerpt(F.col("paragraph")).alias("evidence"))


def listed_page_domains(pages: DataFrame) -> DataFrame:
    """Domains on a list page ``(page_id, url, html)``, without the page's own host family."""
    own = F.coalesce(page_host(F.col("url")), F.lit(""))
    found = page_text(pages).select("page_id", "url", F.explode(F.sort_array(domains(F.col("text")))).alias("domain"))
    return found.filter(~F.array_contains(suffixes(F.col("domain"), include_tld=True), own))


def submissions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual submissions ``(ord, text, source_url)`` → domain sightings and texts (whole text, then its quotes)."""
    sightings = rows.select(
        "ord", "source_url", F.explode(domains(F.col("text"))).alias("domain"), evidence_excerpt(F.col("text")).alias("evidence")
    )
    texts = rows.select(
        "ord", "source_url", F.posexplode(F.concat(F.array("text"), quotes(F.col("text")))).alias("part", "text")
    )
    return sightings, texts


def first_sightings(sightings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First sighting per source and domain by ``ord``."""
    return first_by(sightings, keys or ["source", "domain"], [F.col("ord")])


def domain_outcomes(
    sightings: DataFrame, existing: DataFrame, allowlist: DataFrame, rejected: DataFrame
) -> DataFrame:
    """Sightings with an ``outcome``: known, rejected, allowed, duplicate or new.

    ``sightings(source, source_ord, domain, ...)`` hold one row per source and
    domain. Among sources the first one by ``(source_ord, source)`` that brings a new
    domain wins, so a domain is added once even where two sources share a place.
    """
    names = sightings.select("domain").distinct()
    known = domain_table(existing).withColumn("is_known", F.lit(True))
    roots = F.col("domain").isin(fv.SHARED_PLATFORM_ROOTS)
    barred = domain_table(rejected).withColumn("is_rejected", F.lit(True))
    allowed = listed_keys(names.withColumn("host", F.col("domain")), "host", allowlist, ["domain"], include_tld=True)
    judged = (
        lookup_join(names, known, ["domain"], "left")
        .transform(lambda d: lookup_join(d, barred, ["domain"], "left"))
        .transform(lambda d: d.join(allowed.withColumn("is_allowed", F.lit(True)), "domain", "left"))
    )
    verdict = (
        F.when(F.col("is_known"), "known")
        .when(F.coalesce("is_rejected", F.lit(False)) | roots, "rejected")
        .when(F.col("is_allowed"), "allowed")
        .otherwise("new")
    )
    place = F.struct("source_ord", "source")
    firsts = sightings.groupBy("domain").agg(F.min(place).alias("first_ord"))
    labels = judged.select("domain", verdict.alias("verdict")).join(firsts, "domain")
    later = (F.col("verdict") == "new") & (place > F.col("first_ord"))
    # a domain has at most one row per source here, so no key is hot
    outcome = F.when(later, "duplicate").otherwise(F.col("verdict"))
    return sightings.join(labels, "domain").withColumn("outcome", outcome).drop("verdict", "first_ord")


def domain_table(df: DataFrame) -> DataFrame:
    """Distinct domains of a table as they are written."""
    return df.select("domain").distinct()


def merge_domains(
    sightings: DataFrame, existing: DataFrame, allowlist: DataFrame, rejected: DataFrame, today: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(table, new rows, counters)`` after adding new domains; the table is sorted by domain."""
    judged = domain_outcomes(sightings, existing, allowlist, rejected)
    new = judged.filter("outcome = 'new'").select(
        "domain", "source", "source_url", F.lit(today).alias("first_seen"), "evidence"
    )
    counters = judged.agg(
        F.count_if(F.col("outcome") == "new").alias("new_domains"),
        F.count_if(F.col("outcome") == "allowed").alias("skipped_allowed"),
        F.count_if(F.col("outcome") == "rejected").alias("skipped_rejected"),
    )
    table = existing.select(*new.columns).unionByName(new).orderBy("domain")
    return table, new, counters


def is_template_candidate(template: Column) -> Column:
    """Reads like a fraud message addressed to its reader, not like advice or reporting."""
    return (
        (F.length(template) <= fv.MAX_TEMPLATE_CHARS)
        & (F.size(tokens(template)) >= fv.MIN_TEMPLATE_TOKENS)
        & template.rlike(fv.SCAM_SIGNAL)
        & template.rlike(fv.CALL_TO_ACTION)
        & ~template.rlike(fv.ADVICE_OR_NARRATION)
        & ~template.rlike(fv.REPORTER_LANGUAGE)
        & has_vietnamese_letter(template)
    )


def template_candidates(texts: DataFrame, filter_texts: bool = True) -> DataFrame:
    """Texts ``(ord, text, ...)`` as masked templates that pass the candidate rules."""
    masked = texts.withColumn("text", template_text(F.col("text")))
    return masked.filter(is_template_candidate(F.col("text"))) if filter_texts else masked


def merge_templates(
    texts: DataFrame, existing: DataFrame, rejected: DataFrame, today: str, filter_texts: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(new templates, rejected again)`` from ``texts(ord, text, source, source_url)``.

    ``ord`` is the arrival order (source, page, text). Near copies of a known or
    earlier text are dropped first; a text that is near a rejected fingerprint
    has by then taken its place, so it still blocks later near copies.
    """
    # masked and written once: every step below reads the candidates again
    candidates = cut(template_candidates(texts, filter_texts)).withColumn("sh", shingles(F.col("text")))
    old = existing.select(shingles(F.col("text")).alias("shingles"))
    fresh = candidates.select(F.col("ord").cast("long").alias("id"), F.col("sh").alias("shingles"))
    kept = dedup_against(old, fresh).withColumnRenamed("id", "ord")
    survivors = candidates.withColumn("ord", F.col("ord").cast("long")).join(kept, "ord", "left_semi")
    prints = survivors.select(F.col("ord").alias("id"), as_numbers(fingerprint_of(F.col("sh"))).alias("fp"))
    old_prints = rejected.select(as_numbers(fingerprint_set(F.col("fingerprint"))).alias("fp"))
    barred = fingerprint_matches(prints, old_prints).withColumnRenamed("id", "ord")
    accepted = survivors.join(barred, "ord", "left_anti")
    numbered = assign_ids(accepted, existing, "tpl_", [F.col("ord")])
    new = numbered.select("id", "text", "source", "source_url", F.lit(today).alias("first_seen"))
    return new, survivors.join(barred, "ord", "left_semi").select("ord", "text", "source", "source_url")


def dedup_against(old: DataFrame, fresh: DataFrame, threshold: float = fv.NEAR_DUPLICATE_JACCARD) -> DataFrame:
    """Ids of ``fresh(id, shingles)`` kept by arrival order, all of ``old`` counting as kept."""
    beaten = near_sets(fresh, old, threshold)
    left = fresh.join(beaten, "id", "left_anti")
    return greedy_dedup(left, threshold)


def fingerprint_set(value: Column) -> Column:
    """Stored fingerprint text as an array of hashes."""
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, " "))


def as_numbers(prints: Column) -> Column:
    """Hashes of 12 hex digits as numbers: the same sets, cheaper to compare."""
    return F.transform(prints, lambda h: F.conv(h, 16, 10).cast("long"))


def rejected_match(texts: DataFrame, rejected: DataFrame) -> DataFrame:
    """Ids of ``texts(id, text)`` that are near a rejected fingerprint."""
    own = texts.select("id", as_numbers(fingerprint(F.col("text"))).alias("fp"))
    return fingerprint_matches(own, rejected.select(as_numbers(fingerprint_set(F.col("fingerprint"))).alias("fp")))


def _reason_error(reason: Column) -> Column:
    return F.when(F.length(stripped(reason)) < fv.MIN_REASON_CHARS, F.lit("reason_too_short"))


def reject_domains(
    active: DataFrame, rejected: DataFrame, requests: DataFrame, today: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move domains to the rejected table. ``requests(domain, reason)``; returns (active, rejected, errors)."""
    asked = requests.select(F.lower(stripped(F.col("domain"))).alias("domain"), stripped(F.col("reason")).alias("reason"))
    known = active.select("domain").distinct().withColumn("known", F.lit(True))
    checked = asked.join(known, "domain", "left").withColumn(
        "error", F.coalesce(_reason_error(F.col("reason")), F.when(F.col("known").isNull(), F.lit("unknown_domain")))
    )
    good = checked.filter("error is null")
    kept = lookup_join(active, good.select("domain").distinct(), ["domain"], "left_anti")
    moved = good.select("domain", "reason", F.lit(today).alias("rejected_at"))
    return kept, rejected.unionByName(moved).orderBy("domain"), checked.filter("error is not null").select("domain", "error")


def reject_templates(
    active: DataFrame, rejected: DataFrame, requests: DataFrame, today: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move templates to the rejected table, where only their fingerprint stays. ``requests(id, reason)``."""
    asked = requests.select(stripped(F.col("id")).alias("id"), stripped(F.col("reason")).alias("reason"))
    joined = asked.join(active.select("id", "text"), "id", "left").withColumn(
        "error", F.coalesce(_reason_error(F.col("reason")), F.when(F.col("text").isNull(), F.lit("unknown_template")))
    )
    good = joined.filter("error is null")
    kept = lookup_join(active, good.select("id").distinct(), ["id"], "left_anti")
    moved = good.select(
        F.array_join(fingerprint(F.col("text")), " ").alias("fingerprint"), "reason", F.lit(today).alias("rejected_at")
    )
    return kept, rejected.unionByName(moved), joined.filter("error is not null").select("id", "error")


def source_report(pages: DataFrame, sightings: DataFrame, texts: DataFrame, errors: DataFrame) -> DataFrame:
    """Per source: pages read, distinct domains, texts, errors. Each side is aggregated before it is joined."""
    parts = [
        pages.groupBy("source").agg(F.count("*").alias("articles")),
        sightings.groupBy("source").agg(F.count_distinct("domain").alias("domains")),
        texts.groupBy("source").agg(F.count("*").alias("texts")),
        errors.groupBy("source").agg(F.count("*").alias("errors")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "source", "full")
    return joined.na.fill(0)
