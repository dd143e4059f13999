"""Data-quality rules. Every finding is one row (table, key, rule, severity, detail).

Row rules are arrays of conditions exploded next to the scan, so they need no
shuffle; only uniqueness and distribution rules group rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.similarity import shingles
from ..functions.text import duplicate_text, has_url, nfc, normalize, pii_kinds, refang
from ..functions.urls import domain
from ..operators.joins import join_groups, listed_keys, lookup_join
from ..operators.similarity import copies_of, pairs_of, prefixed_sets
from ..session import cut
from .curation import bool_text, suggestion_error
from .intel import is_template_candidate, rejected_match

FINDING = ["table", "key", "rule", "severity", "detail"]


def rule(name: str, broken: Column, detail: Column | None = None) -> Column:
    """Finding struct when ``broken`` holds, else NULL."""
    text = (F.lit("") if detail is None else detail).cast("string")
    return F.when(broken, F.struct(F.lit(name).alias("rule"), F.coalesce(text, F.lit("")).alias("detail")))


def per_item(name: str, items: Column) -> Column:
    """One finding per array item."""
    return F.transform(items, lambda x: F.struct(F.lit(name).alias("rule"), x.alias("detail")))


def findings(df: DataFrame, table: str, key: Column, single: list[Column], many: list[Column] | None = None) -> DataFrame:
    found = F.array_compact(F.array(*single))
    for items in many or []:
        found = F.concat(found, items)
    rows = df.select(key.cast("string").alias("key"), F.explode(found).alias("f"))
    return rows.select(
        F.lit(table).alias("table"), "key", F.col("f.rule").alias("rule"), F.lit("error").alias("severity"), F.col("f.detail").alias("detail")
    )


def _group_findings(df: DataFrame, table: str, name: str, key: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(
        F.lit(table).alias("table"), key.cast("string").alias("key"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")
    )


def is_date(c: Column) -> Column:
    """A calendar date (2026-02-28, 20260228) or a week date (2026-W09, 2026-W09-6, 2026W096) that exists."""
    day = c.rlike(r"^\d{4}(?:-\d{2}-\d{2}|\d{4})$") & F.try_to_date(F.translate(c, "-", ""), "yyyyMMdd").isNotNull()
    flat = F.translate(c, "-", "")
    shape = c.rlike(r"^\d{4}(?:-W\d{2}(?:-[1-7])?|W\d{2}[1-7]?)$")
    year, week = F.substring(flat, 1, 4).try_cast("int"), F.substring(flat, 6, 2).try_cast("int")
    monday = F.date_trunc("week", F.concat(F.substring(flat, 1, 4), F.lit("-01-04")).try_cast("date")).cast("date")  # of week 1
    falls = F.date_add(monday, (week - 1) * 7 + 3)  # the week's Thursday lies in the week's year
    return F.coalesce(day | (shape & (week >= 1) & (F.year(falls) == year) & (F.weekofyear(falls) == week)), F.lit(False))


def text_rules(text: Column) -> tuple[list[Column], list[Column]]:
    length = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    unknown = F.array_except(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(fv.UNKNOWN_PLACEHOLDER), F.lit(1)))), F.array(*[F.lit(p) for p in fv.PLACEHOLDERS]))
    single = [
        rule("text_not_nfc", nfc(text) != text),
        rule("text_length", ~length.between(fv.MIN_TEXT_LENGTH, fv.MAX_MESSAGE_LENGTH), length),
    ]
    return single, [per_item("text_pii", pii_kinds(text)), per_item("unknown_placeholder", unknown)]


def category_rules(row: str = "") -> list[Column]:
    label, kind = F.col("label"), F.col("scam_type")
    is_scam = label == "scam"
    return [
        rule("label", ~label.isin(fv.LABELS), label),
        rule("scam_type_required", is_scam & ~kind.isin(fv.SCAM_TYPES), kind),
        rule("scam_type_without_scam", ~is_scam & (kind != ""), kind),
        rule("channel", ~F.col("channel").isin(fv.CHANNELS), F.col("channel")),
        rule("source", ~F.col("source").isin(fv.MESSAGE_SOURCES), F.col("source")),
    ]


def metadata_rules() -> list[Column]:
    expected = bool_text(has_url(F.col("text")))
    return [
        rule("id_format", ~F.col("id").rlike(fv.MESSAGE_ID), F.col("id")),
        rule("has_url", F.col("has_url") != expected, expected),
        rule("collected_at", ~is_date(F.col("collected_at")), F.col("collected_at")),
        rule("annotator", F.col("annotator") == ""),
    ]


def check_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """Text, category and metadata rules of dataset rows; broken row shapes get one finding only."""
    shaped = {"_extra", "_missing"} <= set(rows.columns)
    key_of = F.coalesce(F.col(key), F.lit(""))
    single, many = text_rules(F.col("text"))
    if not shaped:
        return findings(rows, "dataset", key_of, [*single, *category_rules(), *metadata_rules()], many)
    shape = findings(rows, "dataset", key_of, [rule("extra_cells", F.col("_extra")), rule("missing_cells", ~F.col("_extra") & F.col("_missing"))])
    whole = rows.filter(~F.col("_extra") & ~F.col("_missing"))
    return shape.unionByName(findings(whole, "dataset", key_of, [*single, *category_rules(), *metadata_rules()], many))


def duplicates(rows: DataFrame, key: Column, order: str, table: str, name: str) -> DataFrame:
    """Every row after the first of its key, with the first row's ``id`` as detail.

    Long keys travel as digests, written once for the two uses.
    """
    keyed = cut(rows.select(F.col(order).alias("_ord"), "id", F.sha2(key.cast("string"), 256).alias("_key")))
    first = keyed.groupBy("_key").agg(F.min(F.struct("_ord", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = join_groups(keyed, first, ["_key"], "n").filter(F.col("_ord") != F.col("first._ord"))
    return _group_findings(joined, table, name, F.col("id"), F.col("first.id"))


def check_unique(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Repeated ids and repeated texts; the first row of each stays clean."""
    return duplicates(rows, F.col("id"), order, "dataset", "duplicate_id").unionByName(
        duplicates(rows, duplicate_text(F.col("text")), order, "dataset", "duplicate_text")
    )


def _label_counts(rows: DataFrame, labels: list[str]) -> DataFrame:
    """``(label, n, total)`` of the wanted labels; the total is a window over one row per label."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(x, True) for x in labels], "label string, wanted boolean")
    every = counts.join(wanted, "label", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.withColumn("total", F.sum("n").over(Window.partitionBy())).filter("wanted").drop("wanted")


def label_shares(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``(label, n, share)``; labels without rows show with 0."""
    share = F.coalesce(F.try_divide("n", "total"), F.lit(0.0))
    return _label_counts(rows, labels or fv.LABELS).select("label", "n", share.alias("share"))


def check_distribution(rows: DataFrame, collecting: bool = False, labels: list[str] | None = None) -> DataFrame:
    """Rare labels and too many synthetic rows; only warnings while data is being collected."""
    severity = "warning" if collecting else "error"
    counted = _label_counts(rows, labels or fv.LABELS).filter("total > 0").withColumn("share", F.col("n") / F.col("total"))
    rare = counted.filter(F.col("share") < fv.MIN_LABEL_SHARE)
    synthetic = rows.agg(F.avg((F.col("source") == "synthetic").cast("double")).alias("synthetic"))
    too_many = synthetic.filter(F.col("synthetic") > fv.MAX_SYNTHETIC_SHARE)
    return _group_findings(rare, "dataset", "label_share", F.col("label"), F.round("share", 4), severity).unionByName(
        _group_findings(too_many, "dataset", "synthetic_share", F.lit("synthetic"), F.round("synthetic", 4), severity)
    )


def check_dataset(rows: DataFrame, collecting: bool = False, order: str = "ord") -> DataFrame:
    """All dataset rules over rows with an arrival order column.

    Rows with too many or too few cells are reported as such; what they seem to hold
    counts neither for uniqueness nor for the shares.
    """
    broken = [F.coalesce(F.col(c), F.lit(False)) for c in ("_extra", "_missing") if c in rows.columns]
    whole = rows.filter(~F.greatest(*broken)) if len(broken) > 1 else rows.filter(~broken[0]) if broken else rows
    return check_rows(rows).unionByName(check_unique(whole, order)).unionByName(check_distribution(whole, collecting))


def check_blocked_domains(rows: DataFrame, allowlist: DataFrame) -> DataFrame:
    name = F.col("domain")
    canonical = domain(name)
    row_rules = [
        rule("first_seen", ~is_date(F.coalesce("first_seen", F.lit(""))), F.col("first_seen")),
        rule("not_canonical", canonical.isNull() | (canonical != name)),
        rule("public_suffix", name.isin(fv.PUBLIC_SUFFIXES) | ~name.contains(".")),
        rule("shared_platform", name.isin(fv.SHARED_PLATFORM_ROOTS)),
        rule("source_missing", F.coalesce("source", F.lit("")) == ""),
        rule("evidence_pii", F.size(pii_kinds(refang(F.coalesce("evidence", F.lit(""))))) > 0),
    ]
    allowed = listed_keys(rows.select("domain", F.col("domain").alias("host")), "host", allowlist, ["domain"], include_tld=True)
    return findings(rows, "blocked_domains", name, row_rules).unionByName(
        _group_findings(rows.join(allowed, "domain", "left_semi"), "blocked_domains", "allowlisted", F.col("domain"), F.lit(""))
    )


def check_templates(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    kinds = pii_kinds(refang(text))
    return findings(
        rows,
        "scam_templates",
        F.col("id"),
        [
            rule("first_seen", ~is_date(F.coalesce("first_seen", F.lit(""))), F.col("first_seen")),
            rule("id_format", ~F.coalesce("id", F.lit("")).rlike(fv.TEMPLATE_ID), F.col("id")),
            rule("not_normalized", normalize(text) != text),
            rule("text_pii", F.size(kinds) > 0, F.array_join(kinds, ",")),
            rule("not_a_candidate", ~is_template_candidate(text)),
            rule("source_missing", F.coalesce("source", F.lit("")) == ""),
        ],
    )


def repeated(rows: DataFrame, column: str, table: str, name: str) -> DataFrame:
    """One finding per value that occurs more than once, with its count."""
    groups = rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
    return _group_findings(groups, table, name, F.col(column), F.col("n"))


def check_near_templates(rows: DataFrame) -> DataFrame:
    """Near-duplicate templates: copies name the first template with the same words, others name each near one."""
    sets = prefixed_sets(rows, shingles(F.col("text")))  # copies and pairs are found in the same written rows
    near = pairs_of(sets, rows, shingles(F.col("text")))
    return _group_findings(copies_of(sets), "scam_templates", "near_duplicate", F.col("rep"), F.col("id")).unionByName(
        _group_findings(near, "scam_templates", "near_duplicate", F.col("id_a"), F.col("id_b"))
    )


def check_intel_unique(domains: DataFrame, templates: DataFrame) -> DataFrame:
    return (
        repeated(domains, "domain", "blocked_domains", "duplicate_domain")
        .unionByName(repeated(templates, "id", "scam_templates", "duplicate_id"))
        .unionByName(check_near_templates(templates))
    )


def check_sources(sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    https = (F.col("kind") != "manual") & ~F.coalesce("url", F.lit("")).startswith("https://")
    rows = findings(
        sources, "sources", name,
        [rule("kind", ~F.coalesce("kind", F.lit("")).isin(kinds or fv.INTEL_KINDS), F.col("kind")), rule("https", F.coalesce(https, F.lit(True)))],
    )
    return rows.unionByName(repeated(sources.select(name.alias("name")), "name", "sources", "duplicate_name"))


def check_allowlist(rows: DataFrame) -> DataFrame:
    canonical = domain(F.col("domain"))
    return findings(rows, "allowed_domains", F.col("domain"), [rule("not_canonical", canonical.isNull() | (canonical != F.col("domain")))])


def check_not_rejected(domains: DataFrame, templates: DataFrame, rejected_domains: DataFrame, rejected_templates: DataFrame) -> DataFrame:
    again = lookup_join(domains, rejected_domains.select("domain").distinct(), ["domain"], "left_semi")
    near = rejected_match(templates, rejected_templates)
    return _group_findings(again, "blocked_domains", "rejected_before", F.col("domain"), F.lit("")).unionByName(
        _group_findings(near, "scam_templates", "rejected_before", F.col("id"), F.lit(""))
    )


def check_intel(
    domains: DataFrame, templates: DataFrame, allowlist: DataFrame, rejected_domains: DataFrame, rejected_templates: DataFrame, sources: DataFrame
) -> DataFrame:
    """All threat table rules."""
    parts = [
        check_blocked_domains(domains, allowlist),
        check_templates(templates),
        check_intel_unique(domains, templates),
        check_not_rejected(domains, templates, rejected_domains, rejected_templates),
        check_sources(sources),
        check_allowlist(allowlist),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def check_candidates(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Candidate rules: id, origin, source, personal data, suggestion."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("suggested_label", "suggested_scam_type", "suggested_channel", "confidence", "note")]
    kinds = pii_kinds(F.col("text"))
    problem = F.when(cells[0] != "", suggestion_error(*cells))
    row_rules = [
        rule("id_format", ~F.col("id").startswith("cand_"), F.col("id")),
        rule("origin", ~F.col("origin").isin(fv.ORIGINS), F.col("origin")),
        rule("source", ~F.col("source").isin(fv.MESSAGE_SOURCES), F.col("source")),
        rule("text_pii", F.size(kinds) > 0, F.array_join(kinds, ",")),
        rule("suggestion", problem.isNotNull(), problem),
    ]
    return findings(rows, "candidates", F.col("id"), row_rules).unionByName(
        duplicates(rows, F.col("id"), order, "candidates", "duplicate_id")
    )
