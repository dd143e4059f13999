"""Table scans and sinks: CSV tables, source registries, domain lists, label-mapped datasets."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.urls import domain
from ..session import cut
from .quoted import BOM, CSV_OPTIONS, read_quoted, tables_of


NAMED = 20  # of the names at fault, so many are told


class TableError(ValueError):
    """A table that must not be read or written this way."""


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def starts_with_bom(spark: SparkSession, path: str) -> bool:
    """First bytes of the table's (first) file; Spark's line reader would hide a byte order mark."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s for s in system.listStatus(hadoop) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not files:
        return False
    stream = system.open(min(files, key=lambda s: s.getPath().getName()).getPath())
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def _csv(spark: SparkSession, multi_line: bool):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    return reader.option("encoding", "UTF-8").option("multiLine", multi_line)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool | None = None
) -> DataFrame:
    """Text table as strings; a missing path is an empty table, missing cells are ``''``.

    Quoted cells may hold line breaks; every file is still read by many tasks (see
    ``quoted``). ``multi_line`` set gives Spark's own scan instead: True reads each file in
    one task, False takes every line for a row.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv" and multi_line is None:
        return read_quoted(spark, path, schema)
    if fmt != "csv":
        return spark.read.format(fmt).load(path).select(*schema.names)
    plain = _csv(spark, multi_line).option("mode", "PERMISSIVE").csv(path)
    renamed = plain.toDF(*[c.lstrip(BOM) for c in plain.columns])
    cells = [
        F.coalesce(F.col(f"`{f.name}`"), F.lit("")) if f.name in renamed.columns else F.lit("") for f in schema.fields
    ]
    return renamed.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cells, schema.fields)])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header cells of a CSV table."""
    line = spark.read.text(path).limit(1).collect()
    return line[0][0].split(",") if line else []


def check_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Error rows ``(table, rule, detail)`` when the file is missing or its header differs."""
    name = PurePosixPath(path).name
    rows = []
    if not path_exists(spark, path):
        rows.append((name, "missing_file", path))
    elif header_of(spark, path) != schema.names:
        rows.append((name, "header", ",".join(schema.names)))
    return spark.createDataFrame(rows, "table string, rule string, detail string")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled dataset for checks: all cells, row shape in ``_extra`` and ``_missing``.

    Refuses a byte order mark, missing columns and an empty table; all files of a folder
    have the same header. Cells a row does not have stay NULL; cells beyond the header
    set ``_extra``. Files are read by many tasks (``quoted``).
    """
    if path_exists(spark, path) and starts_with_bom(spark, path):
        raise TableError("file starts with a byte order mark")
    found = tables_of(spark, path)
    if len(found) > 1:
        raise TableError("files differ in their header")
    header, body = found[0] if found else ([], None)
    missing = [c for c in schemas.MESSAGES.names if c not in header]
    if missing:
        raise TableError(f"missing columns: {', '.join(sorted(missing))}")
    shape = ", ".join(f"`{c}` string" for c in [*header, "_row"])
    options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_row", "nullValue": "\u0000"}
    raw = body.select(F.from_csv("record", shape, options).alias("r")).select("r.*")
    # a malformed row keeps its text, and with it the number of its cells
    cells = F.regexp_count(F.regexp_replace("_row", '"[^"]*+"', ""), F.lit(",")) + 1
    short = F.coalesce(cells < len(header), F.lit(False))
    rows = raw.select(
        *[F.col(f"`{c}`") for c in header],
        (F.col("_row").isNotNull() & ~short).alias("_extra"),
        short.alias("_missing"),
    )
    if rows.isEmpty():
        raise TableError("dataset is empty")
    return rows


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(path)


def write_masked(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Sink for masked tables; a ``raw`` directory is refused."""
    if "raw" in PurePosixPath(path).parts:
        raise TableError("masked output must not go to a raw directory")
    write_table(df, path, fmt)


def read_sources(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Enabled sources of a registry file, with defaults; ``kind`` is ``intel`` or ``training``.

    An unknown source kind, or a public dataset without a license, is an error.
    """
    intel = kind == "intel"
    schema = schemas.INTEL_SOURCES if intel else schemas.TRAINING_SOURCES
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    kinds, items = (fv.INTEL_KINDS, fv.INTEL_MAX_ITEMS) if intel else (fv.TRAINING_KINDS, fv.TRAINING_MAX_ITEMS)
    defaults = {"enabled": True, "max_items": items, "origin": "news", "text_column": "text"}
    filled = raw.select(
        *[
            F.coalesce(F.col(f.name), F.lit(defaults.get(f.name, "")).cast(f.dataType)).alias(f.name)
            if not isinstance(f.dataType, (T.ArrayType, T.MapType))
            else F.col(f.name)
            for f in schema.fields
        ]
    ).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    unknown = ~F.col("kind").isin(kinds)
    bad = [r["kind"] for r in filled.filter(unknown).groupBy("kind").count().orderBy("kind").limit(NAMED).collect()]
    if bad:
        raise TableError(f"unknown source kind: {', '.join(bad)}")
    if not intel:
        open_sets = filled.filter((F.col("kind") == "csv_dataset") & (F.col("license") == ""))
        unlicensed = [r["name"] for r in open_sets.select("name").orderBy("name").limit(NAMED).collect()]
        if unlicensed:
            raise TableError(f"public datasets need a license: {', '.join(unlicensed)}")
    return filled.filter("enabled")


def label_mapped(
    rows: DataFrame, text_column: str, label_column: str | None, label_map: dict[str, str], channel: str = ""
) -> DataFrame:
    """Public dataset as ``(text, hint_label, hint_channel)``; an unmapped label becomes ``''``."""
    text = F.coalesce(F.col(text_column), F.lit("")) if text_column in rows.columns else F.lit("")
    label = F.lit("")
    if label_column and label_map and label_column in rows.columns:
        pairs = [F.lit(x) for item in label_map.items() for x in item]
        mapped = F.try_element_at(F.create_map(*pairs), F.col(label_column))
        label = F.when(mapped.isin(fv.LABELS), mapped).otherwise(F.lit(""))
    return rows.select(text.alias("text"), label.alias("hint_label"), F.lit(channel).alias("hint_channel"))


def domain_list(raw: DataFrame) -> DataFrame:
    """Domains of stored list files ``raw(source, source_url, content)``.

    JSON files give strings, list items and the known keys of objects; objects
    without one are searched further, to any depth. Other files give one entry per
    line, ``#`` lines left out. First entry per domain, in file order.
    """
    parsed = raw.select("source", "source_url", "content", F.try_parse_json("content").alias("json"))
    level = parsed.filter("json is not null").select("source", "source_url", F.array(F.lit(0)).alias("ord"), F.col("json").alias("v"))
    found = None
    while True:  # one round per level of nesting
        kinds = level.withColumn("kind", F.schema_of_variant("v"))
        text = kinds.filter("kind = 'STRING'").select("source", "source_url", "ord", F.col("v").cast("string").alias("entry"))
        objects = kinds.filter("kind like 'OBJECT%'")
        # a key that is there counts, whatever its value; null reads as a word that is no domain
        present = [F.when(F.try_variant_get("v", f"$.{k}", "variant").isNotNull(), F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("None"))) for k in fv.JSON_DOMAIN_KEYS]
        keyed = objects.withColumn("keys", F.array_compact(F.array(*present)))
        by_key = keyed.select("source", "source_url", "ord", F.posexplode("keys").alias("p", "entry")).select(
            "source", "source_url", F.concat("ord", F.array("p")).alias("ord"), "entry"
        )
        entries = text.unionByName(by_key)
        found = entries if found is None else found.unionByName(entries)
        wide = kinds.filter("kind like 'ARRAY%'").select("source", "source_url", "ord", "v").unionByName(
            keyed.filter(F.size("keys") == 0).select("source", "source_url", "ord", "v")
        )
        items = raw.sparkSession.tvf.variant_explode(F.col("v").outer())
        level = wide.lateralJoin(items.select(F.col("pos").alias("p"), F.col("value").alias("item")))
        level = cut(level.select("source", "source_url", F.concat("ord", F.array("p")).alias("ord"), F.col("item").alias("v")))
        if level.isEmpty():
            break
    lines = parsed.filter("json is null").select("source", "source_url", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("p", "entry"))
    kept = lines.filter(F.col("entry").rlike(r"\S") & ~F.col("entry").rlike(r"^\s*#")).select("source", "source_url", F.array("p").alias("ord"), "entry")
    named = found.unionByName(kept).withColumn("domain", domain(F.col("entry"))).filter("domain is not null")
    first = F.min_by(F.struct("source_url"), F.col("ord"))
    return named.groupBy("source", "domain").agg(F.min("ord").alias("ord"), first.alias("r")).select(
        "source", "domain", F.col("r.source_url").alias("source_url"), F.col("source").alias("evidence"), "ord"
    )
