"""Registered queries for table round trips, number masks, threat matches and the rules no other query reaches."""

from __future__ import annotations

import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import fixed_values as fv
from .functions import similarity as text_similarity
from .functions import text, urls
from .operators import joins
from .plans import evaluate, intel, jobs, quality, scoring, split
from .registry import candidates, documents, french_domains, junk_domains, known_offers, known_tables, labelled, link_messages, load, page_domains, pages, query
from .session import shared_folder
from .sources import tables

OTP_TEXT = "Mã xác nhận của bạn là "
ID_TEXT = "Số CCCD: "
WARNING = "Cảnh báo: website lừa đảo "
PLEA = ("Quý khách vui lòng truy cập ", " để xác minh tài khoản")
LANGS = ["en", "fr", "de", "es"]


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _numbered(spark: SparkSession, d: str, lead: str, digits: int) -> DataFrame:
    """One message per document: a number of so many digits behind the keyword, or behind another word in every third one."""
    number = F.lpad(((F.col("doc_id") + 1) % 10**digits).cast("string"), digits, "7")
    before = F.when(F.col("doc_id") % 3 == 0, "Nr ").otherwise(lead)
    return documents(spark, d).select("doc_id", F.concat(before, number, F.lit(" xin cảm ơn")).alias("text"))


@query
def otp_masks(spark, d):
    return _numbered(spark, d, OTP_TEXT, 6).select("doc_id", text.mask_otp(F.col("text")).alias("text"))


@query
def id_masks(spark, d):
    return _numbered(spark, d, ID_TEXT, 12).select("doc_id", text.mask_id(F.col("text")).alias("text"))


@query
def listed_domains(spark, d):
    """A list table with empty cells, capitals and white space around its names."""
    rows = page_domains(spark, d)
    cell = F.when(F.col("lang") == "fr", " \t").when(F.col("lang") == "de", F.concat(F.lit("\n"), F.upper("parent"), F.lit(" "))).otherwise(F.col("parent"))
    return joins.domain_set(rows.select(cell.alias("domain")))


@query
def threat_matches(spark, d):
    threats = scoring.Intel(junk_domains(spark, d), french_domains(spark, d))
    found = scoring.threat_match(link_messages(spark, d), threats)
    return found.select("msg_id", *[F.array_join(c, ",").alias(c) for c in ("blocked_hosts", "brand_links", "url_reasons")])


@query
def csv_round_trip(spark, d):
    """Documents written as a CSV table, with line breaks and quotes in their cells, and read back."""
    path = scratch(spark, "csv")
    tables.write_table(documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text"), path, "csv")
    back = tables.read_table(spark, path, schemas._strings("id text note"))
    return back.select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "note")


@query
def masked_sink(spark, d):
    path = scratch(spark, "masked")
    masked = _numbered(spark, d, OTP_TEXT, 6).select(F.col("doc_id").cast("string").alias("id"), text.mask_otp(F.col("text")).alias("text"))
    tables.write_masked(masked, path)
    return tables.read_table(spark, path, schemas._strings("id text")).select(F.col("id").cast("long").alias("doc_id"), "text")


@query
def source_registry(spark, d):
    """Sources made of the suppliers, read as a registry file: defaults filled in, disabled ones left out."""
    key = F.col("s_suppkey")
    source = F.struct(
        F.concat(F.lit("s"), key.cast("string")).alias("name"),
        F.when(key % 2 == 0, "rss").otherwise("domain_list").alias("kind"),
        F.when(key % 3 == 0, F.lit(False)).alias("enabled"),
        F.when(key % 5 == 0, 7).alias("max_items"),
    )
    path = scratch(spark, "sources")
    files = load(spark, d, "supplier").groupBy((key / 1000).cast("long").alias("file")).agg(F.to_json(F.sort_array(F.collect_list(source))).alias("value"))  # lists of at most 1000 sources
    files.write.partitionBy("file").text(path)  # each list is a file of its own
    return tables.read_sources(spark, path, "intel").select("name", "kind", F.col("max_items").cast("long").alias("max_items"), F.size("keywords").cast("long").alias("keywords"))


@query
def row_shapes(spark, d):
    """A dataset whose rows have too many or too few cells, by channel and label; its files are as many as the tasks that write it."""
    rows = labelled(spark, d)
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    plain = F.concat_ws(",", "id", quoted, "label", "scam_type", "channel", "source", "has_url", "collected_at", "annotator")
    line = F.when(F.col("channel") == "fax", F.concat(plain, F.lit(",more"))).when(F.col("label") == "scam", F.concat_ws(",", "id", quoted)).otherwise(plain)
    path, header = scratch(spark, "shapes"), pa.array([",".join(schemas.MESSAGES.names)])
    lines_of = lambda batches: (pa.RecordBatch.from_arrays([c], names=["value"]) for c in chain([header], (b.column(0) for b in batches)))
    rows.select(line.alias("value")).mapInArrow(lines_of, "value string").write.text(path)
    found = quality.check_rows(tables.read_dataset(spark, path))
    return found.filter(F.col("rule").isin("extra_cells", "missing_cells")).select("key", "rule")


@query
def submitted_domains(spark, d):
    rows = link_messages(spark, d).select(F.col("msg_id").alias("ord"), "text", F.lit("form").alias("source_url"))
    sightings, _ = intel.submissions(rows)
    return sightings.select("ord", "domain", "source_url")


@query
def submitted_texts(spark, d):
    quoted = F.concat(F.lit("They wrote “please open "), F.col("text"), F.lit("” to me"))
    rows = link_messages(spark, d).select(F.col("msg_id").alias("ord"), quoted.alias("text"), F.lit("form").alias("source_url"))
    _, texts = intel.submissions(rows)
    return texts.select("ord", F.col("part").cast("long").alias("part"), "text")


@query
def training_texts(spark, d):
    rows = _numbered(spark, d, OTP_TEXT, 6).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in fv.LABELS]), (F.col("doc_id") % 3 + 1).cast("int")))
    return evaluate.training_rows(rows.withColumnRenamed("doc_id", "id")).select("id", "text", F.col("label_id").cast("long").alias("label_id"))


@query
def prediction_checks(spark, d):
    """Held-out rows with a known label and shares that add up to one."""
    rows = labelled(spark, d)
    part = split.training_parts(evaluate.training_rows(rows), rows)
    model, _ = evaluate.train(part("train"), part("val"), grid=(0.01,))
    told = evaluate.predict(model, part("test").drop("label_id"))
    total = F.col("normal") + F.col("spam") + F.col("scam")
    return told.select("id", F.col("predicted").isin(fv.LABELS).alias("known"), (F.abs(total - 1) < 1e-6).alias("whole"))


@query
def rejected_before(spark, d):
    """Listed domains and templates that had been rejected; every second benchmark text is."""
    rows = page_domains(spark, d)
    listed = rows.select(F.col("parent").alias("domain")).distinct()
    barred = rows.filter("lang = 'fr'").select(F.col("parent").alias("domain"), F.lit("r").alias("reason")).distinct()
    templates = load(spark, d, "benchmark").select(F.format_string("tpl_%06d", "item_id").alias("id"), "text", "item_id")
    none = templates.filter("item_id % 2 = 0").select("id", "text", F.lit("").alias("source"), F.lit("").alias("source_url"), F.lit("").alias("first_seen"))
    asked = none.select("id", F.lit("not a fraud text").alias("reason"))
    empty = none.filter("false").select(F.lit("").alias("fingerprint"), F.lit("").alias("reason"), F.lit("").alias("rejected_at"))
    _, prints, _ = intel.reject_templates(none, empty, asked, "2026-01-02")
    return quality.check_not_rejected(listed, templates.select("id", "text"), barred, prints).select("table", "key", "rule")


def plea(lang):
    """A fraud message in quotes, another one for each language."""
    return F.concat(F.lit(PLEA[0]), F.concat_ws(" ", *[F.concat(lang, F.lit(str(i))) for i in range(9)]), F.lit(PLEA[1]))


def crawl(spark, d) -> DataFrame:
    """Pages as a crawl stored them: whole bodies with a warning at the end of the article; those with a fragment failed."""
    rows = page_domains(spark, d).select("page_id", "lang", "parent", "url").join(pages(spark, d).select("page_id", "html"), "page_id")
    warning = F.concat(F.lit("<p>" + WARNING), "parent", F.lit(" đã nhắn “"), plea(F.col("lang")), F.lit("”</p></article>"))
    kind = F.when(F.col("lang") == "fr", jobs.DOMAIN_LIST).when(F.col("lang") == "es", jobs.DOMAIN_PAGE).otherwise(jobs.ARTICLE)
    body = F.when(F.col("lang") == "fr", F.concat(F.lit("# list\n"), "parent")).otherwise(F.replace("html", F.lit("</article>"), warning))
    return rows.select(
        F.col("lang").alias("source"), F.ascii("lang").alias("source_ord"), kind.alias("kind"), "page_id",
        F.concat(F.lit("https://news.example/"), F.col("page_id").cast("string")).alias("url"), body.alias("content"),
        F.when(F.col("url").contains("#top"), "timeout").alias("error"), "lang", "parent",
    )


def _facts(report: DataFrame, key: str, counters: dict[str, int], spark: SparkSession) -> DataFrame:
    """``(kind, source, name, n)`` of a report's columns and a job's counters."""
    names = [c for c in report.columns if c != key]
    long = report.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in names])).alias("m"))
    told = long.select(F.lit("report").alias("kind"), F.col(key).alias("source"), "m.name", "m.n")
    rows = spark.createDataFrame([("counter", "", k, int(v)) for k, v in sorted(counters.items())], "kind string, source string, name string, n long")
    return told.unionByName(rows)


@query
def intel_update(spark, d):
    """One update of the threat tables from all pages; the German message had been rejected before, a French one is a template already."""
    existing, allowed, rejected = known_tables(spark, d)
    one = lambda lang: spark.range(1).select(text.template_text(plea(F.lit(lang))).alias("text"))
    templates = one("fr").select(F.lit("tpl_000007").alias("id"), "text", F.lit("old").alias("source"), F.lit("").alias("source_url"), F.lit("2025-01-01").alias("first_seen"))
    barred = one("de").select(F.array_join(text_similarity.fingerprint(F.col("text")), " ").alias("fingerprint"))
    crawled = crawl(spark, d).drop("lang", "parent")
    done = jobs.update_intel(crawled, existing, templates, allowed, rejected, barred, "2026-01-01", mode="block")
    added = done.new_domains.select(F.lit("domain").alias("kind"), "source", F.col("domain").alias("name"), F.lit(1).cast("long").alias("n"))
    named = done.new_templates.select(F.lit("template").alias("kind"), "source", F.col("id").alias("name"), F.lit(1).cast("long").alias("n"))
    return added.unionByName(named).unionByName(_facts(done.report, "source", done.counters, spark))


@query
def source_collection(spark, d):
    """One collection of training texts from all pages; every second site's robots file bars training."""
    rows = crawl(spark, d)
    stored = rows.select(
        F.col("source").alias("source_name"), "source_ord", F.lit("news").alias("origin"), F.col("parent").alias("host"), "page_id", "url",
        F.replace("content", F.lit(" đã nhắn “"), F.concat(F.lit(" đã nhắn “"), F.col("parent").substr(1, 4), F.lit(" "))).alias("html"), "error",
    )
    robots = rows.select(F.col("parent").alias("host")).distinct().select("host", F.when(F.length("host") % 2 == 0, "User-agent: GPTBot\nDisallow: /").otherwise("User-agent: *\nAllow: /").alias("text"))
    done = jobs.collect_sources(stored, robots, candidates(spark, d), known_offers(spark, d), "2026-01-01", mode="block")
    return _facts(done.report, "source_name", done.counters, spark)


@query
def numeric_hosts(spark, d):
    """Addresses written as one number, in hexadecimal, in octal parts or with a long last part."""
    n = (F.col("page_id") * 2654435761) % 2**32
    octets = [F.shiftright(n, k).bitwiseAND(F.lit(255)) for k in (24, 16, 8, 0)]
    forms = [
        n.cast("string"), F.concat(F.lit("0x"), F.lower(F.hex(n))), F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(o.cast("string"), 10, 8)) for o in octets]),
        F.concat_ws(".", octets[0].cast("string"), (n % 2**24).cast("string")),
    ]
    shape = F.element_at(F.array(*forms), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, d).select("page_id", urls.host(F.concat(F.lit("http://me@"), shape, F.lit(":8080/x"))).alias("host"))


@query
def header_findings(spark, d):
    """Tables written by language, whose headers are right, in another order or short of a column, and one that isn't there."""
    path = scratch(spark, "headers")
    rows = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.lit("").alias("source_url"), F.lit("2026-01-01").alias("first_seen"), "lang")
    names = schemas.TEMPLATES.names
    found = tables.check_header(spark, f"{path}/none.csv", schemas.TEMPLATES)
    for lang, columns in (("en", names), ("fr", names[::-1]), ("de", names[:-1]), ("es", names)):
        tables.write_table(rows.filter(F.col("lang") == lang).select(*columns), f"{path}/{lang}.csv", "csv")
        found = found.unionByName(tables.check_header(spark, f"{path}/{lang}.csv", schemas.TEMPLATES))
    return found.select("table", "rule")
