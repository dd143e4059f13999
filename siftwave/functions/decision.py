"""Model outputs and the label decision as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import let, parse_label
from .urls import combine, noisy_or

PROBABILITIES = "struct<normal:double,spam:double,scam:double>"


def reaches(probability: Column, threshold: float) -> Column:
    return probability >= F.lit(threshold - fv.THRESHOLD_TOLERANCE)


def softmax(logits: Column, label_order: list[str] | None = None) -> Column:
    """Probabilities struct of three logits; the order must name each label once."""
    order = fv.LABELS if label_order is None else [str(x).strip().lower() for x in label_order]
    if sorted(order) != sorted(fv.LABELS):
        raise ValueError(f"label order must list each of {', '.join(fv.LABELS)} exactly once")

    def shifted(values: Column) -> Column:
        top = F.array_max(values)
        return F.transform(values, lambda x: F.exp(x - top))

    def shares(exponents: Column) -> Column:
        total = F.aggregate(exponents, F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(*[(exponents[order.index(x)] / total).alias(x) for x in fv.LABELS])

    doubles = logits.cast("array<double>")
    return F.when(F.size(logits) == len(order), let(let(doubles, shifted), shares))


def argmax_label(values: Column, labels: list[str] | None = None) -> Column:
    """Label of the first maximum."""
    names = F.array(*[F.lit(x) for x in (labels or fv.LABELS)])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def llm_verdict(content: Column) -> Column:
    """Probabilities struct of a JSON reply with label and confidence; NULL when unusable."""
    reply = F.from_json(content, "label string, confidence double")

    def spread(r: Column) -> Column:
        label = parse_label(r["label"])
        sure = F.least(F.greatest(r["confidence"], F.lit(fv.MIN_LLM_CONFIDENCE)), F.lit(1.0))
        rest = (F.lit(1.0) - sure) / 2
        shares = F.struct(*[F.when(label == x, sure).otherwise(rest).alias(x) for x in fv.LABELS])
        return F.when(label.isNotNull() & r["confidence"].isNotNull(), shares)

    return let(reply, spread)


def signal_confidence(blocked: Column, template_coverage: Column) -> Column:
    return F.when(blocked, F.lit(fv.BLOCKLISTED_CONFIDENCE)).otherwise(
        F.coalesce(template_coverage, F.lit(0.0))
    )


def threat_reasons(blocked: Column, template_coverage: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(blocked, F.lit("url_blocklisted")),
            F.when(template_coverage.isNotNull(), F.lit("matches_known_scam_template")),
        )
    )


RESULT = "struct<label:string,confidence:double,reasons:array<string>>"


def _result(label: Column, confidence: Column, reasons: Column) -> Column:
    return F.struct(
        label.alias("label"), confidence.cast("double").alias("confidence"), F.array_distinct(reasons).alias("reasons")
    )


def fuse(
    prediction: Column,
    url_reasons: Column,
    threshold: float = fv.SCAM_THRESHOLD,
    blocked: Column | None = None,
    template_coverage: Column | None = None,
) -> Column:
    """Label, confidence and reasons from model probabilities, link risk and known-threat signals."""
    blocked = F.lit(False) if blocked is None else blocked
    template_coverage = F.lit(None).cast("double") if template_coverage is None else template_coverage
    normal, spam, scam = (F.coalesce(prediction[x], F.lit(0.0)) for x in fv.LABELS)

    def decide(probability: Column) -> Column:
        is_scam = reaches(probability, threshold) | blocked | template_coverage.isNotNull()
        by_model = F.array_compact(F.array(F.when(reaches(scam, threshold), F.lit("model_predicted_scam"))))
        as_scam = _result(
            F.lit("scam"),
            F.greatest(probability, signal_confidence(blocked, template_coverage)),
            F.concat(by_model, threat_reasons(blocked, template_coverage), url_reasons),
        )
        is_spam = spam > normal
        kept = F.when(is_spam, spam).otherwise(normal)
        notes = F.array_compact(
            F.array(
                F.when(is_spam, F.lit("model_predicted_spam")),
                F.when(probability > kept, F.lit("scam_probability_below_threshold")),
            )
        )
        label = F.when(is_spam, F.lit("spam")).otherwise(F.lit("normal"))
        return F.when(is_scam, as_scam).otherwise(_result(label, kept, F.concat(notes, url_reasons)))

    return let(combine(scam, noisy_or(url_reasons)), decide)


def classify(
    error: Column,
    prediction: Column,
    url_reasons: Column,
    blocked: Column,
    template_coverage: Column,
    threshold: float = fv.SCAM_THRESHOLD,
) -> Column:
    """Decision order for one message: error, strong signal, no model, model."""
    strong = blocked | template_coverage.isNotNull()
    by_signal = _result(
        F.lit("scam"),
        signal_confidence(blocked, template_coverage),
        F.concat(threat_reasons(blocked, template_coverage), url_reasons),
    )

    def without_model(risk: Column) -> Column:
        return F.when(reaches(risk, threshold), _result(F.lit("scam"), risk, url_reasons))

    return (
        F.when(error.isNotNull(), F.lit(None).cast(RESULT))
        .when(strong, by_signal)
        .when(prediction.isNull(), let(noisy_or(url_reasons), without_model))
        .otherwise(fuse(prediction, url_reasons, threshold))
    )


def status(error: Column, result: Column) -> Column:
    return (
        F.when(error.isNotNull(), error)
        .when(result.isNull(), F.lit("classification.model_unavailable"))
        .otherwise(F.lit("ok"))
    )
