"""RSS and Atom feeds through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse
from ..schemas import fields
from .html import unescape

RSS_ITEM = fields("title string, link string, pubDate string, description string")
ATOM_ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_VALUE", T.StringType())]))),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)
ITEM = fields("title string, link string, published string, summary string")


def clean_feed_text(c: Column) -> Column:
    """Entities decoded, tags removed, entities decoded again, spaces collapsed."""
    return collapse(unescape(F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")))


def _rss() -> list[Column]:
    blank = F.lit("")
    return [
        clean_feed_text(F.col("title")).alias("title"),
        F.trim(F.coalesce("link", blank)).alias("link"),
        F.trim(F.coalesce("pubDate", blank)).alias("published"),
        clean_feed_text(F.col("description")).alias("summary"),
    ]


def _atom() -> list[Column]:
    blank = F.lit("")
    first = F.try_element_at("link", F.lit(1))
    return [
        clean_feed_text(F.col("title")).alias("title"),
        F.trim(F.coalesce(first["_VALUE"], first["_href"], blank)).alias("link"),
        F.trim(F.coalesce("published", "updated", blank)).alias("published"),
        clean_feed_text(F.col("summary")).alias("summary"),
    ]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items ``(title, link, published, summary)`` of feed files; RSS items win over Atom entries."""
    reader = spark.read.format("xml").option("mode", "PERMISSIVE").option("ignoreNamespace", True)
    rss = reader.option("rowTag", "item").schema(RSS_ITEM).load(path).select(*_rss())
    if not rss.isEmpty():
        return rss
    return reader.option("rowTag", "entry").schema(ATOM_ENTRY).load(path).select(*_atom())


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Items of stored feeds ``feeds(source, url, xml)`` with their position in the feed."""

    def elements(tag: str) -> Column:
        return F.regexp_extract_all("xml", F.lit(rf"(?s)(<{tag}[\s>].*?</{tag}>)"), F.lit(1))

    both = feeds.select("source", "url", elements("item").alias("items"), elements("entry").alias("entries"))

    def parsed(column: str, schema: T.StructType, tag: str, columns: list[Column], keep: Column) -> DataFrame:
        rows = both.filter(keep).select("source", "url", F.posexplode(column).alias("pos", "x"))
        options = {"rowTag": tag, "ignoreNamespace": "true"}
        flat = rows.withColumn("i", F.from_xml("x", schema.simpleString(), options)).select("source", "url", "pos", "i.*")
        return flat.select("source", "url", "pos", *columns)

    has_items = F.size("items") > 0
    rss = parsed("items", RSS_ITEM, "item", _rss(), has_items)
    return rss.unionByName(parsed("entries", ATOM_ENTRY, "entry", _atom(), ~has_items))
