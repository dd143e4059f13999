"""From collected texts to the labelled dataset: collect, suggest, review, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import has_url, has_vietnamese_letter, mask_normalized, may_contain_name, normalize, pii_kinds, stripped, text_key
from ..operators.ids import assign_ids, format_id, row_numbers
from ..operators.joins import BROADCAST_ROWS, first_by, lookup_join
from ..session import cut

SYNTHETIC_NOTE = "Tin sinh tổng hợp theo yêu cầu, cần người duyệt"  # fixed value
SUGGESTED = ["suggested_label", "suggested_scam_type", "suggested_channel", "confidence", "note"]
DATASET_COLUMNS = ["id", "text", "label", "scam_type", "channel", "source", "has_url", "collected_at", "annotator"]


def bool_text(c: Column) -> Column:
    return F.when(c, F.lit("true")).otherwise(F.lit("false"))


def anonymize(rows: DataFrame, start_id: int = 1, order: str = "ord") -> DataFrame:
    """Raw messages as dataset rows: masked text, stripped cells, new ids in input order."""
    missing = {"text", "label", "channel", "source", "collected_at", "annotator"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    cells = {
        c: stripped(F.col(c)) if c in rows.columns else F.lit("") for c in DATASET_COLUMNS if c not in ("id", "text", "has_url")
    }
    # masked before it is numbered: numbering writes its rows to the checkpoint folder
    masked = rows.select(F.col(order).alias("_by"), mask_normalized(F.coalesce("text", F.lit(""))).alias("text"), *[c.alias(n) for n, c in cells.items()])
    numbered = row_numbers(masked, [F.col("_by")], start=start_id, column="_n").withColumn("id", format_id("msg_", F.col("_n")))
    return numbered.withColumn("has_url", bool_text(has_url(F.col("text")))).select(*DATASET_COLUMNS)


def pii_counts(rows: DataFrame) -> DataFrame:
    """``(kind, rows)``: texts per kind of personal data."""
    kinds = rows.select(F.explode(pii_kinds(normalize(F.col("text")))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("rows"))


def names_to_review(rows: DataFrame) -> DataFrame:
    return rows.filter(may_contain_name(F.col("text"))).select("id")


def known_keys(candidates: DataFrame, dataset: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Distinct keys of everything already waiting, accepted or judged."""
    waiting = candidates.select(text_key(F.col("text")).alias("key"))
    accepted = dataset.select(text_key(F.col("text")).alias("key"))
    return waiting.unionByName(accepted).unionByName(reviewed.select("key")).distinct()


def text_problem(masked: Column, vietnamese_only: bool = True) -> Column:
    """``invalid`` or ``name``; NULL for a usable text."""
    usable = F.length(masked).between(fv.MIN_TEXT_LENGTH, fv.MAX_MESSAGE_LENGTH)
    if vietnamese_only:
        usable = usable & has_vietnamese_letter(masked)
    return F.when(~usable, "invalid").when(may_contain_name(masked), "name")


def collect_outcomes(offers: DataFrame, known: DataFrame, vietnamese_only: bool = True) -> DataFrame:
    """Offers ``(ord, text, ...)`` with masked text, ``key`` and ``outcome``.

    ``ord`` is a unique arrival order. Outcomes: invalid, name, duplicate, added, tested in
    this order. The first usable text per key is found with a map-side minimum and
    joined back on ``ord``, so copies of one text meet no hot key.
    """
    masked = offers.withColumn("text", mask_normalized(F.coalesce("text", F.lit(""))))
    checked = cut(masked.withColumn("problem", text_problem(F.col("text"), vietnamese_only)).withColumn("key", text_key(F.col("text"))))  # masked once
    firsts = checked.filter("problem is null").groupBy("key").agg(F.min("ord").alias("ord"))
    new = firsts.join(known.select("key").distinct(), "key", "left_anti").select("ord", F.lit("added").alias("added"))
    joined = checked.join(new, "ord", "left")
    return joined.withColumn("outcome", F.coalesce("problem", "added", F.lit("duplicate"))).drop("problem", "added")


def collection_report(outcomes: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Counts per source: added, duplicate, name, invalid."""
    kinds = ["added", "duplicate", "name", "invalid"]
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    return outcomes.groupBy(*(groups or ["source_name"])).agg(*counts)


def within_cap(outcomes: DataFrame, cap: int = fv.MAX_NEW_CANDIDATES) -> DataFrame:
    """Outcomes of the sources that are still read: a source is left out once ``cap`` texts were added before it.

    ``outcomes`` hold ``source_ord``. The running sum is over one row per source.
    """
    added = cut(outcomes.groupBy("source_ord").agg(F.count_if(F.col("outcome") == "added").alias("n")))
    before = Window.orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    read = added.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < cap)
    return lookup_join(outcomes, read.select("source_ord"), ["source_ord"], "left_semi")


def new_candidates(outcomes: DataFrame, existing: DataFrame, today: str, cap: int = fv.MAX_NEW_CANDIDATES) -> DataFrame:
    """Candidate rows for the first ``cap`` added texts, ids continuing after the existing ones."""
    # masked and written once; decided on narrow columns; then the texts of the chosen rows are fetched, at most ``cap``
    outcomes = cut(outcomes)
    chosen = within_cap(outcomes.select("ord", "source_ord", "outcome"), cap).filter("outcome = 'added'").orderBy("source_ord", "ord").limit(cap).select("ord")
    picked = F.broadcast(chosen) if cap <= BROADCAST_ROWS else chosen
    added = outcomes.join(picked, "ord", "left_semi")
    numbered = assign_ids(added, existing, "cand_", [F.col("source_ord"), F.col("ord")])
    blank = F.lit("")
    hints = [F.col(c) if c in outcomes.columns else blank.alias(c) for c in ("hint_label", "hint_channel")]
    return numbered.select(
        "id", "text", "origin", "source", "source_url", F.lit(today).alias("collected_at"), *hints, *[blank.alias(c) for c in SUGGESTED]
    )


def manual_offers(rows: DataFrame) -> DataFrame:
    """Manual messages ``(ord, text, label, channel, source_url, note)`` as offers."""
    label = F.when(F.col("label").isin(fv.LABELS), F.col("label")).otherwise(F.lit(""))
    return rows.select(
        "ord", "text", F.lit("manual").alias("origin"), F.lit("contributed").alias("source"), "source_url",
        label.alias("hint_label"), F.coalesce("channel", F.lit("")).alias("hint_channel"),
    )


def suggestion_error(label: Column, scam_type: Column, channel: Column, confidence: Column, note: Column) -> Column:
    """Error code of a label suggestion, NULL when it is valid."""
    short = F.length(stripped(note)) < fv.MIN_NOTE_CHARS
    exclude = label == "exclude"
    return (
        F.when(exclude & short, "note")
        .when(exclude, None)
        .when(~label.isin(fv.LABELS), "label")
        .when((label == "scam") & ~scam_type.isin(fv.SCAM_TYPES), "scam_type")
        .when((label != "scam") & (scam_type != ""), "scam_type_without_scam")
        .when(~channel.isin(fv.CHANNELS), "channel")
        .when(~confidence.isin(fv.CONFIDENCE_LEVELS), "confidence")
        .when(short, "note")
    )


def check_suggestions(suggestions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(id, error)`` of suggestions that are invalid or name no candidate."""
    cells = [stripped(F.col(c)) for c in ("label", "scam_type", "channel", "confidence", "note")]
    judged = suggestions.select("id", suggestion_error(*cells).alias("error"))
    unknown = suggestions.join(candidates.select("id").distinct(), "id", "left_anti").select("id", F.lit("unknown_id").alias("error"))
    known_bad = judged.filter("error is not null").join(candidates.select("id").distinct(), "id", "left_semi")
    return unknown.unionByName(known_bad)


def apply_suggestions(candidates: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Candidates with their last suggestion ``(ord, id, label, scam_type, channel, confidence, note)``.

    Nothing is applied while ``check_suggestions`` has rows: then it raises.
    """
    wrong = check_suggestions(suggestions, candidates).groupBy("error").count().orderBy("error").collect()  # a row per kind of error
    if wrong:
        raise ValueError("suggestions are not applied: " + ", ".join(f"{r['error']} ({r['count']})" for r in wrong))
    cells = dict(zip(SUGGESTED, ("label", "scam_type", "channel", "confidence", "note")))
    last = first_by(
        suggestions.select("id", "ord", *[stripped(F.col(c)).alias(f"_{s}") for s, c in cells.items()]), ["id"], [-F.col("ord")]
    ).drop("ord")
    joined = candidates.join(last, "id", "left")
    new = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cells else F.col(c) for c in candidates.columns]
    return joined.select(*new)


def unlabelled(candidates: DataFrame, limit: int = 40, order: str = "id") -> DataFrame:
    """First candidates without a suggestion."""
    return candidates.filter(F.coalesce("suggested_label", F.lit("")) == "").orderBy(order).limit(limit)


def apply_reviews(
    candidates: DataFrame, decisions: DataFrame, annotator: str, today: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(remaining candidates, accepted messages, reviewed keys)``.

    ``decisions(candidate_id, accept, label, scam_type, channel)``, the last one per
    candidate counts when they have an ``ord``.
    """
    if "ord" in decisions.columns:
        decisions = first_by(decisions, ["candidate_id"], [-F.col("ord")])
    verdict = decisions.select(
        F.col("candidate_id").alias("id"), F.struct("accept", "label", "scam_type", "channel").alias("d")
    )
    joined = candidates.join(verdict, "id", "left")
    remaining = joined.filter("d is null").drop("d")
    accepted = F.col("d.accept") & ~F.coalesce("d.label", F.lit("")).isin("", "exclude")
    judged = joined.filter("d is not null").withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    reviewed = judged.select(
        text_key(F.col("text")).alias("key"),
        F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("decision"),
        F.lit(today).alias("decided_at"),
    )
    channel = F.coalesce("d.channel", F.lit(""))
    messages = judged.filter("accepted").select(
        F.col("id").alias("candidate_id"),
        "text",
        F.col("d.label").alias("label"),
        F.when(F.col("d.label") == "scam", F.coalesce("d.scam_type", F.lit(""))).otherwise("").alias("scam_type"),
        F.when(channel == "", "other").otherwise(channel).alias("channel"),
        "source",
        "collected_at",
        F.lit(annotator).alias("annotator"),
    )
    return remaining, messages, reviewed


def append_messages(dataset: DataFrame, messages: DataFrame, order: str = "candidate_id") -> DataFrame:
    """Dataset with the new messages: next ids in order, ``has_url`` from the text."""
    new = assign_ids(messages, dataset, "msg_", [F.col(order)]).withColumn("has_url", bool_text(has_url(F.col("text"))))
    return dataset.select(*DATASET_COLUMNS).unionByName(new.select(*DATASET_COLUMNS))


def synthetic_candidates(rows: DataFrame, existing: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """Synthetic rows ``(ord, text, label, scam_type, channel)`` that were added, with a ready suggestion."""
    offers = rows.select(
        "ord", "text", F.lit("synthetic").alias("origin"), F.lit("synthetic").alias("source"), F.lit("").alias("source_url"),
        F.coalesce("label", F.lit("")).alias("hint_label"), F.lit("").alias("hint_channel"), F.lit(0).alias("source_ord"),
        "scam_type", "channel",
    )
    added = collect_outcomes(offers, known).filter("outcome = 'added'")
    numbered = assign_ids(added, existing, "cand_", [F.col("ord")])
    return numbered.select(
        "id", "text", "origin", "source", "source_url", F.lit(today).alias("collected_at"), "hint_label", "hint_channel",
        stripped(F.col("hint_label")).alias("suggested_label"), stripped(F.col("scam_type")).alias("suggested_scam_type"),
        stripped(F.col("channel")).alias("suggested_channel"), F.lit("high").alias("confidence"), F.lit(SYNTHETIC_NOTE).alias("note"),
    )
