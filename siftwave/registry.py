"""Registered queries: every operator over the whole driver tables.

The tables stand in for the real ones: ``documents`` and ``conversations`` are
messages, ``benchmark`` holds the templates, ``pages`` gives links, feeds, robots
files and link-rich messages (derived from its addresses by Spark), ``labels``
gives labels and decisions, ``events`` requests and reports, ``embeddings``
logits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decision, text, urls
from .functions import fixed_values as fv
from .functions import similarity as sets
from .operators import ids, joins
from .operators import similarity as similar
from .plans import curation, epochs, evaluate, intel, policy, quality, reports, scoring, split
from .sources import feeds, html, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A driver table. A file with fewer splits than cores is spread by ``key`` for CPU-bound work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, key)
    return df


def documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages", "page_id")


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events", "event_id").withColumn("ts", F.col("ts").cast("timestamp"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("msg_id"), "text")


def document_sets(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("id"), sets.shingles(F.col("text")).alias("shingles"))


def template_sets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(
        F.format_string("tpl_%06d", "item_id").alias("tpl_id"), sets.shingles(F.col("text")).alias("shingles")
    )


def variant(url: Column) -> Column:
    """Page address as a fraud message would write it: brand imitation or bracketed dots."""
    brand = F.replace(url, F.lit(".example.com"), F.lit("-vietcornbank.xyz"))
    return F.replace(brand, F.lit(".example.net"), F.lit("[.]example[.]net"))


def link_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with links, one per page."""
    return pages(spark, d).select(
        F.col("page_id").alias("msg_id"), F.concat(F.lit("Check "), variant(F.col("url")), F.lit(" now")).alias("text")
    )


def page_domains(spark: SparkSession, d: str) -> DataFrame:
    """``(page_id, lang, host, parent)`` of the page addresses."""
    name = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return load(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"), name.alias("host"),
        F.regexp_replace(name, r"^(?:www|m|blog)\.", "").alias("parent"),
    )


def junk_domains(spark: SparkSession, d: str) -> DataFrame:
    """Blocklist: site domains with a dash in them."""
    return page_domains(spark, d).filter(F.col("parent").contains("-")).select(F.col("parent").alias("domain")).distinct()


def french_domains(spark: SparkSession, d: str) -> DataFrame:
    """Allowlist: domains of the French pages."""
    return page_domains(spark, d).filter("lang = 'fr'").select(F.col("parent").alias("domain")).distinct()


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


# --- similarity ---------------------------------------------------------------------


@query
def template_best_match(spark, d):
    found = similar.best_template(document_sets(spark, d).withColumnRenamed("id", "msg_id"), template_sets(spark, d))
    return found.select(F.col("msg_id").alias("doc_id"), "tpl_id", F.round("coverage", 9).alias("coverage"))


@query
def template_coverage(spark, d):
    found = similar.template_matches(document_sets(spark, d).withColumnRenamed("id", "msg_id"), template_sets(spark, d), 0.3)
    return found.select(F.col("msg_id").alias("doc_id"), "tpl_id", F.round("coverage", 9).alias("coverage"))


@query
def near_duplicate_pairs(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    found = similar.near_pairs(rows, shingles=sets.shingles(F.col("text")))
    return found.select("id_a", "id_b", F.round("jaccard", 9).alias("jaccard"))


@query
def copy_groups(spark, d):
    return similar.fold_equal_sets(document_sets(spark, d))


@query
def greedy_dedup(spark, d):
    return similar.greedy_dedup(document_sets(spark, d))


@query
def fingerprints(spark, d):
    prints = documents(spark, d).select("doc_id", sets.fingerprint(F.col("text")).alias("fp"))
    return prints.select("doc_id", F.size("fp").cast("long").alias("n"), F.md5(F.array_join("fp", " ")).alias("digest"))


@query
def rejected_near_copies(spark, d):
    docs = documents(spark, d)
    toxic = load(spark, d, "labels").filter("toxic = 1").select("doc_id")
    rejected = docs.join(toxic, "doc_id", "left_semi").select(F.array_join(sets.fingerprint(F.col("text")), " ").alias("fingerprint"))
    return intel.rejected_match(docs.select(F.col("doc_id").alias("id"), "text"), rejected).withColumnRenamed("id", "doc_id")


@query
def turn_similarity(spark, d):
    turns = load(spark, d, "conversations", "conv_id").select("conv_id", "turn", sets.shingles(F.col("text")).alias("sh"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("sh").alias("next_sh"))
    both = turns.join(after, ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn",
        F.round(sets.jaccard(F.col("sh"), F.col("next_sh")), 9).alias("jaccard"),
        F.round(sets.coverage(F.col("sh"), F.col("next_sh")), 9).alias("coverage"),
    )


@query
def token_counts(spark, d):
    return documents(spark, d).select(
        "doc_id", F.size(sets.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(sets.shingles(F.col("text"))).cast("long").alias("n_shingles")
    )


@query
def neighbour_words(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = load(spark, d, "conversations", "conv_id").select(words.alias("w")).select(
        F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p")
    )
    distinct = pairs.select("p.a", "p.b").distinct()
    return distinct.select("a", "b", urls.osa_within_1(F.col("a"), F.col("b")).alias("near")).filter("near")


# --- text ---------------------------------------------------------------------------


@query
def normalize_text(spark, d):
    normal = text.normalize(F.col("text"))
    return documents(spark, d).select("doc_id", F.length(normal).cast("long").alias("n"), F.md5(normal).alias("digest"))


@query
def message_errors(spark, d):
    return scoring.prepared(messages(spark, d)).select(F.col("msg_id").alias("doc_id"), "error").filter("error is not null")


@query
def text_keys(spark, d):
    return documents(spark, d).select("doc_id", text.text_key(F.col("text")).alias("key"))


@query
def repeated_texts(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "text")
    found = quality.duplicates(rows, text.duplicate_text(F.col("text")), "ord", "documents", "duplicate_text")
    return found.select(F.col("key").alias("doc_id"), F.col("detail").alias("first_id"))


@query
def mask_email(spark, d):
    masked = text.mask_email(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(masked).alias("digest"), F.regexp_count(masked, F.lit("<EMAIL>")).cast("long").alias("n"))


@query
def refang_text(spark, d):
    return link_messages(spark, d).select("msg_id", text.refang(F.col("text")).alias("text"))


@query
def restore_links(spark, d):
    return link_messages(spark, d).select("msg_id", text.restore(F.col("text")).alias("text"))


@query
def mask_links(spark, d):
    return link_messages(spark, d).select("msg_id", text.mask(F.col("text")).alias("text"))


@query
def mask_documents(spark, d):
    masked = text.mask_normalized(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(masked).alias("digest"), F.length(masked).alias("n"))


@query
def mask_keeping_links(spark, d):
    return link_messages(spark, d).select("msg_id", text.mask_keep_urls(text.restore(F.col("text"))).alias("text"))


@query
def pii_kind_counts(spark, d):
    return curation.pii_counts(documents(spark, d))


@query
def email_texts(spark, d):
    kinds = text.pii_kinds(F.col("text"))
    return documents(spark, d).filter(F.array_contains(kinds, "email")).select("doc_id")


@query
def links_present(spark, d):
    return link_messages(spark, d).select("msg_id", text.has_url(F.col("text")).alias("has_url"))


@query
def name_candidates(spark, d):
    named = load(spark, d, "conversations", "conv_id").withColumn("text", F.concat_ws(" ", F.concat(F.col("role"), F.lit(": anh")), "text"))
    return named.filter(text.may_contain_name(F.col("text"))).select("conv_id", "turn")


@query
def keyword_texts(spark, d):
    return documents(spark, d).filter(text.contains_keyword(F.col("text"), ["Und ", "para "])).select("doc_id")


@query
def quoted_passages(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.lit(0).alias("pos"), F.concat(F.lit("“"), F.replace(F.col("text"), F.lit("\n"), F.lit("” “")), F.lit("”")).alias("paragraph"))
    return html.quotes_of(rows).select(F.col("page_id").alias("doc_id"), F.col("quote_pos").cast("long").alias("pos"), F.md5("quote").alias("digest"))


@query
def page_blocks(spark, d):
    rows = load(spark, d, "conversations", "conv_id")
    return rows.filter(text.is_page_block(F.col("text"))).select("conv_id", "turn")


@query
def parsed_codes(spark, d):
    rows = load(spark, d, "labels")
    label = F.when(F.col("toxic") == 1, F.lit(" Scam\t")).when(F.col("quality") == 1, F.lit("NORMAL")).otherwise(F.lit("unknown"))
    channel = F.when(F.col("toxic") == 1, F.lit("Telegram ")).otherwise(F.lit("sms"))
    return rows.select("doc_id", text.parse_label(label).alias("label"), text.parse_report_channel(channel).alias("channel"))


# --- links and hosts ----------------------------------------------------------------


@query
def url_hosts(spark, d):
    return pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))


@query
def literal_links(spark, d):
    found = pages(spark, d).select("page_id", F.posexplode(urls.urls(F.concat(F.lit("see ("), F.col("url"), F.lit("), then www.x.vn/a!")))).alias("pos", "url"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query
def inspectable_links(spark, d):
    return pages(spark, d).select("page_id", urls.inspectable_link(F.col("url")).alias("link"))


@query
def distinct_links(spark, d):
    return pages(spark, d).select(urls.inspectable_link(F.col("url")).alias("link")).distinct()


@query
def unwrapped_redirects(spark, d):
    wrapped = F.concat(F.lit("https://l.facebook.com/l.php?u="), F.url_encode("url"), F.lit("&h=x"))
    mixed = F.when(F.col("url").startswith("https"), wrapped).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", urls.unwrap_redirect(mixed).alias("target"))


@query
def normalized_domains(spark, d):
    rows = pages(spark, d).select("page_id", F.upper(F.regexp_replace("url", r"[?#].*", "")).alias("value"))
    return rows.select("page_id", urls.domain(F.col("value")).alias("domain"))


@query
def text_domains(spark, d):
    found = link_messages(spark, d).select("msg_id", F.explode(urls.domains(F.col("text"))).alias("domain"))
    return found


@query
def skeletons(spark, d):
    tokens = page_domains(spark, d).select(F.explode(F.split("host", "[.-]")).alias("token")).distinct()
    return tokens.select("token", urls.skeleton(F.col("token")).alias("skeleton"))


@query
def blocked_links(spark, d):
    rows = page_domains(spark, d).select("page_id", "host")
    return joins.suffix_join(rows, "host", junk_domains(spark, d), ["page_id"]).select("page_id", "host")


@query
def not_allowed_links(spark, d):
    rows = page_domains(spark, d).select("page_id", "host")
    return joins.suffix_join(rows, "host", french_domains(spark, d), ["page_id"], include_tld=True, how="left_anti").select("page_id", "host")


@query
def brand_imitations(spark, d):
    hosts = link_messages(spark, d).select(F.explode(urls.link_facts(F.col("text"))["host"]).alias("host")).distinct()
    return hosts.select("host", urls.brand_like(F.col("host")).alias("brand"))


@query
def url_findings(spark, d):
    found = scoring.url_findings(link_messages(spark, d))
    return found.select("msg_id", F.col("pos").cast("long").alias("pos"), "url", "reason")


@query
def described_reasons(spark, d):
    found = scoring.url_findings(link_messages(spark, d)).select("msg_id", "reason").distinct()
    return scoring.describe_reasons(found)


@query
def url_risk(spark, d):
    facts = urls.link_facts(text.normalize(F.col("text")))
    reasons = F.flatten(facts["reasons"])
    return link_messages(spark, d).select("msg_id", F.round(urls.noisy_or(reasons), 9).alias("risk"))


@query
def link_verdicts(spark, d):
    rows = link_messages(spark, d).select(F.col("msg_id").alias("link_id"), F.regexp_replace("text", "^Check | now$", "").alias("url"))
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d))
    return scoring.inspect_links(rows, threats).select("link_id", "verdict", joined(F.col("reasons")).alias("reasons"))


@query
def link_request_errors(spark, d):
    url = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.concat(F.lit("http://a.example/"), F.col("event_id")))
    rows = events(spark, d).select(F.concat_ws("/", F.col("user_id"), F.col("event_type")).alias("request_id"), url.alias("url"))
    return scoring.request_errors(rows)


# --- decision -----------------------------------------------------------------------


def page_predictions(spark, d) -> DataFrame:
    """Model probabilities derived from the page address length."""
    n = F.length("url")
    return load(spark, d, "pages").select(
        F.col("page_id").alias("msg_id"),
        ((n * 7) % 50 / 100.0).alias("normal"), ((n * 3) % 50 / 100.0).alias("spam"), ((n * 11) % 100 / 100.0).alias("scam"),
    )


def _scored(df: DataFrame) -> DataFrame:
    return df.select("msg_id", "status", "label", F.round("confidence", 9).alias("confidence"), joined(F.col("reasons")).alias("reasons"))


@query
def score_link_messages(spark, d):
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d))
    return _scored(scoring.score_messages(link_messages(spark, d), threats, page_predictions(spark, d)))


@query
def score_without_model(spark, d):
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d))
    return _scored(scoring.score_messages(link_messages(spark, d), threats))


@query
def score_documents(spark, d):
    templates = load(spark, d, "benchmark").select(F.format_string("tpl_%06d", "item_id").alias("id"), "text")
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d), templates)
    return _scored(scoring.score_messages(messages(spark, d), threats))


@query
def model_queue(spark, d):
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d))
    return scoring.messages_for_model(link_messages(spark, d), threats).select("msg_id", "masked")


@query
def fused_labels(spark, d):
    rows = documents(spark, d).join(load(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    shares = F.struct(
        (n % 40 / 100.0).alias("normal"), (n % 30 / 100.0).alias("spam"), (n % 100 / 100.0).alias("scam")
    )
    reasons = F.array_compact(F.array(F.when(F.col("toxic") == 1, "url_suspicious_tld"), F.when(F.col("quality") == 0, "url_shortener")))
    out = rows.select("doc_id", decision.fuse(shares, reasons).alias("r"))
    return out.select("doc_id", F.col("r.label").alias("label"), F.round("r.confidence", 9).alias("confidence"), joined(F.col("r.reasons")).alias("reasons"))


@query
def fallback_predictions(spark, d):
    first = page_predictions(spark, d).filter("scam >= 0.5")
    second = page_predictions(spark, d).select("msg_id", F.lit(1.0).alias("normal"), F.lit(0.0).alias("spam"), F.lit(0.0).alias("scam"))
    return scoring.fill_predictions(first, second)


def third_sums(vector: Column) -> Column:
    """Three logits out of a whole vector: the sum of every third component, from the first, second and third on."""
    places = F.sequence(F.lit(1), F.size(vector))
    part = lambda k: F.aggregate(F.filter(places, lambda i: i % 3 == k), F.lit(0.0), lambda acc, i: acc + F.element_at(vector, i).cast("double"))
    return F.array(part(1), part(2), part(0))


@query
def softmax_scores(spark, d):
    rows = load(spark, d, "embeddings", "vec_id").select("vec_id", decision.softmax(third_sums(F.col("embedding"))).alias("p"))
    return rows.select("vec_id", *[F.round(f"p.{x}", 9).alias(x) for x in fv.LABELS])


@query
def argmax_labels(spark, d):
    return load(spark, d, "embeddings", "vec_id").select("vec_id", decision.argmax_label(third_sums(F.col("embedding"))).alias("label"))


@query
def llm_verdicts(spark, d):
    label = F.when(F.col("event_type") == "click", " SCAM ").when(F.col("event_type") == "view", "spam").when(F.col("event_type") == "error", "none").otherwise("normal")
    reply = F.to_json(F.struct(label.alias("label"), (F.col("value") / 10).alias("confidence")))
    rows = events(spark, d).select("event_id", decision.llm_verdict(reply).alias("p")).filter("p is not null")
    return rows.select("event_id", *[F.round(f"p.{x}", 9).alias(x) for x in fv.LABELS])


# --- dataset quality, split, evaluation -----------------------------------------------


def labelled(spark, d) -> DataFrame:
    """Labelled messages: documents with a label row; some cells are wrong on purpose."""
    rows = documents(spark, d).join(load(spark, d, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "scam").when(F.col("quality") == 1, "normal").otherwise("spam")
    return rows.select(
        F.col("doc_id").alias("ord"),
        ids.format_id("msg_", F.col("doc_id")).alias("id"),
        "text",
        label.alias("label"),
        F.when(F.col("toxic") == 1, "job_scam").when(F.col("lang") == "fr", "other").otherwise("").alias("scam_type"),
        F.when(F.col("lang") == "de", "fax").otherwise("sms").alias("channel"),
        F.when(F.col("source") == "src0", "synthetic").otherwise("collected").alias("source"),
        F.lit("false").alias("has_url"),
        F.when(F.col("lang") == "es", "2026-02-30").otherwise("2026-02-28").alias("collected_at"),
        F.when(F.col("source") == "src1", "").otherwise("a1").alias("annotator"),
    )


@query
def category_findings(spark, d):
    rows = labelled(spark, d)
    return quality.findings(rows, "dataset", F.col("id"), quality.category_rules())


@query
def metadata_findings(spark, d):
    rows = labelled(spark, d).withColumn("text", F.lit("no link here"))
    return quality.findings(rows, "dataset", F.col("id"), quality.metadata_rules())


@query
def dataset_findings(spark, d):
    return quality.check_dataset(labelled(spark, d))


@query
def uniqueness_findings(spark, d):
    rows = labelled(spark, d).withColumn("id", F.substring("id", 1, 8))
    return quality.check_unique(rows).select("key", "rule", "detail")


@query
def label_shares(spark, d):
    return quality.label_shares(labelled(spark, d)).select("label", "n", F.round("share", 9).alias("share"))


@query
def distribution_findings(spark, d):
    return quality.check_distribution(labelled(spark, d), collecting=True).select("key", "rule", "severity")


@query
def repeated_ids(spark, d):
    rows = labelled(spark, d).withColumn("id", F.substring("id", 1, 9))
    return quality.repeated(rows, "id", "dataset", "duplicate_id").select("key", "detail")


@query
def blocked_domain_findings(spark, d):
    rows = page_domains(spark, d).groupBy("parent").agg(F.min("page_id").alias("p"), F.min("lang").alias("lang")).select(
        F.when(F.col("lang") == "de", F.upper("parent")).otherwise(F.col("parent")).alias("domain"),
        F.when(F.col("lang") == "es", "").otherwise("crawl").alias("source"),
        F.lit("2026-01-05").alias("first_seen"), F.lit("seen on a list").alias("evidence"),
    )
    return quality.check_blocked_domains(rows, french_domains(spark, d)).select("key", "rule")


@query
def near_template_findings(spark, d):
    rows = documents(spark, d).select(F.format_string("tpl_%06d", "doc_id").alias("id"), "text")
    return quality.check_near_templates(rows).select("key", "detail")


@query
def template_findings(spark, d):
    rows = load(spark, d, "benchmark").select(F.format_string("tpl_%06d", "item_id").alias("id"), "text", F.lit("s").alias("source"), F.lit("2026-01-01").alias("first_seen"))
    return quality.check_templates(rows)


@query
def source_findings(spark, d):
    rows = page_domains(spark, d).select(
        F.col("parent").alias("name"), F.when(F.col("lang") == "fr", "ftp").otherwise("rss").alias("kind"), "url"
    )
    return quality.check_sources(rows).select("key", "rule")


@query
def allowlist_findings(spark, d):
    rows = page_domains(spark, d).select(F.col("host").alias("domain")).distinct()
    return quality.check_allowlist(rows).select("key", "rule")


@query
def candidate_findings(spark, d):
    return quality.check_candidates(candidates(spark, d).withColumn("ord", F.col("id"))).select("key", "rule")


@query
def stratified_split(spark, d):
    return split.split(labelled(spark, d).select("id", "label", "source"))


@query
def split_with_fixed_test(spark, d):
    rows = labelled(spark, d).select("id", "label", "source")
    return split.split(rows, existing_test=rows.filter("label = 'scam' and source <> 'synthetic'"))


@query
def fixed_test_errors(spark, d):
    rows = labelled(spark, d).select("id", "label", "source", "channel")
    frozen = rows.withColumn("id", F.when(F.col("channel") == "fax", F.concat("id", F.lit("x"))).otherwise(F.col("id"))).withColumn(
        "label", F.when(F.col("source") == "synthetic", F.col("label")).otherwise(F.replace(F.col("label"), F.lit("spam"), F.lit("scam")))
    )
    return split.verify_test(frozen, rows)


@query
def labels_without_test(spark, d):
    rows = labelled(spark, d)
    return split.labels_without_test(rows, rows.filter("label = 'scam'"))


@query
def label_metrics(spark, d):
    pairs = load(spark, d, "labels").select("doc_id", F.col("quality").alias("expected"), F.col("toxic").alias("predicted"))
    return evaluate.metrics(pairs).select(*[F.round(c, 9).alias(c) for c in ("macro_f1", "scam_f1", "accuracy")])


@query
def confusion_counts(spark, d):
    return evaluate.confusion(load(spark, d, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted")))


@query
def largest_logit_gap(spark, d):
    rows = load(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("logits"))
    other = rows.select("id", F.transform("logits", lambda x: x * 0.75).alias("logits"))
    return evaluate.max_abs_diff(rows, other).select(F.round("max_abs_diff", 9).alias("max_abs_diff"))


@query
def classifier_predictions(spark, d):
    rows = labelled(spark, d)
    part = split.training_parts(evaluate.training_rows(rows), rows)
    trained = epochs.train_by_epochs(part("train"), part("val"))
    return epochs.predict(trained.weights, part("test").drop("label_id"))


# --- threat table update --------------------------------------------------------------


def sightings(spark, d) -> DataFrame:
    """Domains seen per source: the language of the page is the source."""
    rows = page_domains(spark, d)
    order = F.ascii("lang")  # two languages share a place
    seen = rows.select(F.col("lang").alias("source"), order.alias("source_ord"), F.col("page_id").alias("ord"), F.col("parent").alias("domain"), F.col("url").alias("source_url"), F.col("host").alias("evidence"))
    return intel.first_sightings(seen)


def known_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Existing, allowed and rejected domains, taken from the page addresses."""
    rows = page_domains(spark, d)
    existing = rows.filter("host like 'm.%'").groupBy(F.col("parent").alias("domain")).agg(
        F.lit("old").alias("source"), F.min("url").alias("source_url"), F.lit("2025-01-01").alias("first_seen"), F.lit("").alias("evidence")
    )
    allowed = rows.filter("url like '%.html%'").select(F.col("parent").alias("domain")).distinct()
    rejected = rows.filter("url like '%utm_source%'").select(F.col("parent").alias("domain"), F.lit("a reason long enough").alias("reason"), F.lit("2025-01-01").alias("rejected_at")).distinct()
    return existing, allowed, rejected


@query
def domain_outcomes(spark, d):
    existing, allowed, rejected = known_tables(spark, d)
    return intel.domain_outcomes(sightings(spark, d), existing, allowed, rejected).select("source", "domain", "ord", "outcome")


@query
def merged_domains(spark, d):
    table, _, _ = intel.merge_domains(sightings(spark, d), *known_tables(spark, d), "2026-01-01")
    return table


@query
def domain_counters(spark, d):
    _, _, counters = intel.merge_domains(sightings(spark, d), *known_tables(spark, d), "2026-01-01")
    return counters


@query
def rejected_domains(spark, d):
    existing, _, rejected = known_tables(spark, d)
    asked = page_domains(spark, d).filter("lang = 'fr'").select(F.col("parent").alias("domain"), F.col("url").alias("reason"))
    asked = asked.groupBy("domain").agg(F.max("reason").alias("reason"))
    kept, moved, errors = intel.reject_domains(existing, rejected, asked, "2026-01-01")
    parts = [kept.select("domain", F.lit("active").alias("place")), moved.select("domain", F.lit("rejected").alias("place")), errors.select("domain", F.col("error").alias("place"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def rejected_templates(spark, d):
    active = load(spark, d, "benchmark").select(F.format_string("tpl_%06d", "item_id").alias("id"), "text", F.lit("s").alias("source"), F.lit("u").alias("source_url"), F.lit("2026-01-01").alias("first_seen"))
    asked = load(spark, d, "labels").filter("toxic = 1").select(F.format_string("tpl_%06d", "doc_id").alias("id"), F.lit("not a fraud text").alias("reason"))
    old = active.filter("false").select(F.lit("").alias("fingerprint"), F.lit("").alias("reason"), F.lit("").alias("rejected_at"))
    _, moved, _ = intel.reject_templates(active, old, asked, "2026-01-02")
    return moved.select(F.md5("fingerprint").alias("digest"), "reason", "rejected_at")


@query
def warned_page_domains(spark, d):
    rows = pages(spark, d).select(
        "page_id", "url", F.lit(0).alias("pos"), F.concat(F.lit("Beware of this website: "), variant(F.col("url"))).alias("paragraph")
    )
    return intel.warned_domains(rows).select("page_id", "domain")


@query
def list_page_domains(spark, d):
    rows = pages(spark, d).select("page_id", "url", F.concat(F.lit("<nav>x.vn</nav><table><td>"), variant(F.col("url")), F.lit("</td><td>shop.example.org</td></table>")).alias("html"))
    return intel.listed_page_domains(rows).select("page_id", "domain")


@query
def template_additions(spark, d):
    """New templates from Vietnamese messages built around the page addresses and document words."""
    rows = fraud_texts(spark, d)
    none = rows.filter("false")
    existing = none.select(F.lit("").alias("id"), "text")
    rejected = none.select(F.lit("").alias("fingerprint"))
    new, _ = intel.merge_templates(rows, existing, rejected, "2026-01-01")
    return new.select("id", F.md5("text").alias("digest"), "source")


def fraud_texts(spark, d) -> DataFrame:
    words = F.array_join(sets.tokens(F.col("text")), " ")
    return documents(spark, d).select(
        F.col("doc_id").alias("ord"), "source", F.lit("").alias("source_url"),
        F.concat(F.lit("Quý khách vui lòng truy cập "), words, F.lit(" để xác minh tài khoản")).alias("text"),
    )


@query
def template_candidate_texts(spark, d):
    return intel.template_candidates(fraud_texts(spark, d)).select("ord", F.md5("text").alias("digest"))


@query
def evidence_excerpts(spark, d):
    return documents(spark, d).select("doc_id", text.evidence_excerpt(F.col("text")).alias("evidence"))


@query
def crawl_report(spark, d):
    rows = page_domains(spark, d)
    texts = rows.filter("url like '%html%'").select(F.col("lang").alias("source"))
    errors = rows.filter("url like '%#top'").select(F.col("lang").alias("source"))
    return intel.source_report(rows.select(F.col("lang").alias("source")), sightings(spark, d), texts, errors)


@query
def domain_list_entries(spark, d):
    rows = load(spark, d, "pages", "page_id")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    content = F.when(
        F.col("url").startswith("https"), F.to_json(F.array(F.struct(F.col("url").alias("url"))))
    ).otherwise(F.concat(F.lit("# list\n"), host, F.lit("\n\n  shop.vn/x")))
    raw = rows.select(F.col("page_id").cast("string").alias("source"), F.col("url").alias("source_url"), content.alias("content"))
    return tables.domain_list(raw).select("source", "domain")


# --- pages, feeds, robots --------------------------------------------------------------


@query
def page_texts(spark, d):
    return html.page_text(pages(spark, d)).select("page_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query
def page_anchors(spark, d):
    return html.page_links(pages(spark, d)).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query
def page_paragraphs(spark, d):
    return html.paragraphs(pages(spark, d), "depth").select("page_id", F.col("pos").cast("long").alias("pos"), "paragraph")


@query
def page_block_paragraphs(spark, d):
    return html.paragraphs(pages(spark, d), "block").select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("digest"))


@query
def page_ads(spark, d):
    return html.class_texts(pages(spark, d), "ad").select("page_id", "pos", "text")


@query
def feed_items(spark, d):
    item = F.concat(
        F.lit("<rss><channel><item><title>News &amp;amp; more</title><link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")),
        F.lit("</link><pubDate>x</pubDate><description><![CDATA[<p>Cảnh báo</p>]]></description></item></channel></rss>"),
    )
    rows = pages(spark, d).select(F.col("page_id").cast("string").alias("source"), "url", item.alias("xml"))
    return feeds.parse_feeds(rows).select("source", "title", "link", "summary")


def _items(spark, d) -> DataFrame:
    rows = page_domains(spark, d)
    return rows.select(
        F.col("lang").alias("source"), F.lit(7).alias("max_items"), F.array(F.lit("EXAMPLE.COM"), F.lit("example.net")).alias("keywords"),
        F.col("page_id").alias("pos"), F.col("host").alias("title"),
        F.when(F.col("url").startswith("https"), F.col("url")).otherwise("").alias("link"), F.lit("").alias("summary"),
    )


@query
def feed_articles(spark, d):
    return intel.article_links(_items(spark, d)).select("source", "pos", "link")


@query
def feed_articles_training(spark, d):
    return intel.article_links(_items(spark, d), empty_links_first=True).select("source", "pos", "link")


@query
def robots_policy(spark, d):
    named = F.when(F.col("lang") == "fr", "GPTBot").when(F.col("lang") == "de", "CCBot # all").otherwise("*")
    signal = F.when(F.col("url").startswith("http:"), "Content-Signal: search=yes, ai-train=no\n").otherwise("")
    body = F.concat(
        F.lit("User-agent: Other\nUser-agent: "), named, F.lit("\nAllow: /x\nDisallow: /\n"), signal, F.lit("User-agent: ClaudeBot\nDisallow: /private\n")
    )
    rows = page_domains(spark, d).select(F.col("page_id").cast("string").alias("host"), body.alias("text"))
    return policy.training_policy(rows).select("host", "allowed", "reason", joined(F.col("agents")).alias("agents"))


# --- curation and reports ---------------------------------------------------------------


def candidates(spark, d) -> DataFrame:
    """Candidates: one per labelled document."""
    rows = labelled(spark, d)
    blank = F.lit("")
    return rows.select(
        ids.format_id("cand_", F.col("ord")).alias("id"), "text",
        F.when(F.col("channel") == "fax", "radio").otherwise("news").alias("origin"), "source", blank.alias("source_url"),
        F.lit("2026-01-01").alias("collected_at"), blank.alias("hint_label"), blank.alias("hint_channel"),
        F.when(F.col("label") == "spam", "").otherwise(F.col("label")).alias("suggested_label"), F.col("scam_type").alias("suggested_scam_type"),
        F.col("channel").alias("suggested_channel"), F.lit("high").alias("confidence"), F.lit("a note").alias("note"),
    )


@query
def known_text_keys(spark, d):
    docs = documents(spark, d)
    turns = load(spark, d, "conversations", "conv_id")
    reviewed = load(spark, d, "benchmark").select(text.text_key(F.col("text")).alias("key"))
    return curation.known_keys(docs, turns, reviewed)


def offers(spark, d) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("ord"), "text", F.col("source").alias("source_name"), F.substring("source", 4, 5).cast("int").alias("source_ord")
    )


def known_offers(spark, d) -> DataFrame:
    return load(spark, d, "benchmark").select(text.text_key(F.col("text")).alias("key"))


@query
def collected_texts(spark, d):
    return curation.collect_outcomes(offers(spark, d), known_offers(spark, d), vietnamese_only=False).select("ord", "key", "outcome")


@query
def collection_report(spark, d):
    return curation.collection_report(curation.collect_outcomes(offers(spark, d), known_offers(spark, d), vietnamese_only=False))


@query
def capped_sources(spark, d):
    rows = labelled(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("ord"), F.substring("source", 4, 5).cast("int").alias("source_ord")), "ord")
    outcomes = rows.select("ord", "source_ord", F.when(F.col("label") == "normal", "added").otherwise("duplicate").alias("outcome"))
    return curation.within_cap(outcomes, 100).select("ord", "source_ord", "outcome")


@query
def first_items_per_source(spark, d):
    rows = documents(spark, d).select("doc_id", "source", (F.length("source") * 2).alias("most"))
    return intel.max_items(rows, "source", "most", "doc_id").select("doc_id", "source")


@query
def new_candidate_rows(spark, d):
    outcomes = curation.collect_outcomes(offers(spark, d), known_offers(spark, d), vietnamese_only=False)
    ready = outcomes.withColumn("origin", F.lit("news")).withColumn("source", F.col("source_name")).withColumn("source_url", F.lit(""))
    return curation.new_candidates(ready, candidates(spark, d), "2026-01-01").select("id", "source", F.md5("text").alias("digest"))


@query
def suggestion_errors(spark, d):
    rows = candidates(spark, d)
    asked = rows.select(
        F.when(F.col("source") == "synthetic", F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("id"),
        F.col("suggested_label").alias("label"), F.col("suggested_scam_type").alias("scam_type"), F.col("suggested_channel").alias("channel"), "confidence", "note",
    )
    return curation.check_suggestions(asked, rows)


@query
def applied_suggestions(spark, d):
    turns = load(spark, d, "conversations", "conv_id")
    waiting = turns.select(F.col("conv_id").cast("string").alias("id")).distinct()
    for c in curation.SUGGESTED:
        waiting = waiting.withColumn(c, F.lit(""))
    asked = turns.select(
        F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", " normal").otherwise("spam\t").alias("label"), F.lit("").alias("scam_type"),
        F.lit("sms").alias("channel"), F.lit("low").alias("confidence"), F.concat(F.lit("seen in turn "), F.col("turn").cast("string")).alias("note"),
    )
    return curation.apply_suggestions(waiting, asked).select("id", "suggested_label", "note")


@query
def unlabelled_candidates(spark, d):
    return curation.unlabelled(candidates(spark, d)).select("id")


def _reviews(spark, d):
    decisions = labelled(spark, d).filter("source = 'collected'").select(
        ids.format_id("cand_", F.col("ord")).alias("candidate_id"), (F.col("annotator") != "").alias("accept"),
        F.when(F.col("channel") == "fax", "exclude").otherwise(F.col("label")).alias("label"), F.lit("job_scam").alias("scam_type"), F.lit("").alias("channel"),
    )
    return curation.apply_reviews(candidates(spark, d), decisions, "a7", "2026-01-01")


@query
def accepted_messages(spark, d):
    return _reviews(spark, d)[1].select("candidate_id", "label", "scam_type", "channel", "source", "annotator")


@query
def reviewed_keys(spark, d):
    return _reviews(spark, d)[2]


@query
def remaining_candidates(spark, d):
    return _reviews(spark, d)[0].select("id")


@query
def appended_messages(spark, d):
    dataset = labelled(spark, d).filter("label = 'scam'")
    _, accepted, _ = _reviews(spark, d)
    return curation.append_messages(dataset, accepted).select("id", "label", "annotator")


@query
def sequential_ids(spark, d):
    rows = documents(spark, d).select("doc_id", "source")
    old = load(spark, d, "labels").select(F.format_string("msg_%06d", "doc_id").alias("id"))
    return ids.assign_ids(rows, old, "msg_", [F.col("source"), F.col("doc_id")]).select("doc_id", "id")


@query
def next_id_number(spark, d):
    return ids.next_number(load(spark, d, "labels").select(F.format_string("msg_%06d", "doc_id").alias("id")), "msg_").select(F.col("next").cast("long").alias("next"))


@query
def anonymized_rows(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("ord"), "text", F.lit(" normal ").alias("label"), F.lit("sms").alias("channel"), "source", F.lit("2026-01-01").alias("collected_at"), F.lit("a1").alias("annotator"))
    return curation.anonymize(rows).select("id", "label", "source", "has_url", F.md5("text").alias("digest"))


@query
def synthetic_candidates(spark, d):
    rows = fraud_texts(spark, d).select("ord", "text", F.lit("scam").alias("label"), F.lit("job_scam").alias("scam_type"), F.lit("sms").alias("channel"))
    known = known_offers(spark, d)
    return curation.synthetic_candidates(rows, candidates(spark, d), known, "2026-01-01").select("id", "suggested_label", F.md5("text").alias("digest"))


@query
def label_mapped_rows(spark, d):
    mapped = tables.label_mapped(documents(spark, d), "text", "lang", {"en": "normal", "fr": "spam", "de": "ham"}, "sms")
    return mapped.select(F.md5("text").alias("digest"), "hint_label", "hint_channel")


def report_requests(spark, d) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "Spam").when(F.col("event_type") == "error", "none").otherwise("scam")
    channel = F.when(F.col("event_type") == "click", "telegram").otherwise("api")
    return events(spark, d).select(
        F.col("event_id").alias("request_id"), F.concat_ws(" ", "event_type", "props").alias("text"), label.alias("label"), channel.alias("channel"), F.col("ts").alias("created_at")
    )


@query
def submitted_reports(spark, d):
    done = reports.submit_reports(report_requests(spark, d))
    return done.select("id", "masked_text", "reported_label", "channel", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query
def listed_reports(spark, d):
    done = reports.submit_reports(report_requests(spark, d))
    return reports.list_reports(done, "2024-01-15 00:00:00", 1000).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query
def review_file_rows(spark, d):
    return reports.review_rows(reports.submit_reports(report_requests(spark, d)))


@query
def requests_over_limit(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("client"), "ts")
    out = reports.over_limit(rows, limit=3, window="1 day")
    return out.select("client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "refused")


@query
def refused_requests(spark, d):
    rows = events(spark, d).select("event_id", F.col("user_id").alias("client"), "ts")
    return reports.refused_requests(rows, limit=3, window="1 day").select("event_id")
