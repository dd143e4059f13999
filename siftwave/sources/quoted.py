"""Parallel scan of CSV files whose quoted cells hold line breaks.

A plain multi-line scan reads each file in one task, since a task that starts in the
middle can't know whether it stands inside a quoted cell. Here the file is scanned as
lines of byte ranges (blocks), twice:

1. per block, how many of its lines have an odd number of quotes. Prefix sums of
   these say for every block whether it starts inside a quoted cell;
2. every task folds its lines into records from that parity. A record that runs over
   the end of a block is handed on in pieces, which meet by the block it began in.

Doubled quotes inside a cell leave the parity as it is. Records are then parsed by
Spark's CSV parser, one by one. Only pieces of records that cross a block are
shuffled. The table of blocks has one row per split of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

BOM = "﻿"
PIECES = "file string, block long, nth long, piece string, kind string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, value)``: raw lines in file order inside a task, with the offset of their byte range."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def blocks(rows: DataFrame) -> DataFrame:
    """``(file, block, inside, owner)`` of every byte range.

    ``inside`` says that it starts inside a quoted cell; ``owner`` is then the range in
    which that record began.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2
    sums = cut(rows.groupBy("file", "block").agg(F.sum(odd).alias("odd")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1
    placed = sums.withColumn("inside", inside)
    begins = F.when(~F.col("inside") | (F.col("odd") > 0), F.col("block"))  # a record begins in it
    return placed.select("file", "block", "inside", F.when(F.col("inside"), F.last(begins, ignorenulls=True).over(earlier)).alias("owner"))


def _folded(starts: dict[tuple[str, int], bool]):
    """Records and pieces of a task's lines; ``kind`` is ``whole``, ``head`` (the end of a record begun earlier) or ``tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        nth, held, open_, foreign = 0, [], False, False
        for batch in batches:
            out: list[tuple[str, int, int, str, str]] = []
            files, offsets, values = batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()
            odd = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_pylist()
            for file, block, value, flips in zip(files, offsets, values, odd):
                if (file, block) != at:
                    if held:
                        out.append((*at, nth, "\n".join(held), "head" if foreign else "tail"))
                    at, nth, held = (file, block), 0, []
                    open_ = foreign = starts[at]
                held.append(value)
                if flips:
                    open_ = not open_
                if not open_:
                    out.append((*at, nth, "\n".join(held), "head" if foreign else "whole"))
                    nth, held, foreign = nth + 1, [], False
            yield _rows(out)
        if held:
            yield _rows([(*at, nth, "\n".join(held), "head" if foreign else "tail")])

    return run


def _rows(out: list[tuple[str, int, int, str, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["file", "block", "nth", "piece", "kind"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, nth, record)``: the text of every record; ``block`` and ``nth`` order a file's records."""
    rows = lines(spark, path)
    table = blocks(rows)
    known = table.collect()  # one narrow row per byte range of the files
    pieces = rows.mapInArrow(_folded({(r.file, r.block): r.inside for r in known}), PIECES)
    pieces = cut(pieces)
    begun = table.filter("inside").select("file", "block", "owner")
    whole = pieces.filter("kind = 'whole'").select("file", "block", "nth", F.col("piece").alias("record"))
    heads = pieces.filter("kind = 'head'").join(begun, ["file", "block"]).select("file", "owner", "block", "nth", "piece")
    tails = pieces.filter("kind = 'tail'").select("file", F.col("block").alias("owner"), "block", "nth", "piece")
    parts = F.sort_array(F.collect_list(F.struct("block", "nth", "piece")))
    joined = heads.unionByName(tails).groupBy("file", "owner").agg(parts.alias("parts"))  # pieces of one record
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "\n")
    return whole.unionByName(joined.select("file", F.col("owner").alias("block"), F.element_at("parts", 1)["nth"].alias("nth"), text.alias("record")))


def tables_of(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """``(header cells, (record))`` for each different header among the files; blank lines are skipped."""
    found = cut(records(spark, path))
    rows = found.select("file", "block", "nth", F.regexp_replace("record", r"\r$", "").alias("record")).filter("record <> ''")
    first = rows.groupBy("file").agg(F.min(F.struct("block", "nth", "record")).alias("h"))
    heads = cut(first.select("file", "h.block", "h.nth", F.regexp_replace("h.record", f"^{BOM}", "").alias("header")))
    out = []
    for header in sorted(r.header for r in heads.select("header").distinct().collect()):  # mostly one
        own = heads.filter(F.col("header") == header).select("file", F.col("block").alias("head_block"), F.col("nth").alias("head_nth"))
        body = rows.join(F.broadcast(own), "file").filter("block <> head_block OR nth <> head_nth")  # one row per file
        out.append((_cells(spark, header), body.select("record")))
    return out


CSV_OPTIONS = {"quote": '"', "escape": '"', "emptyValue": "", "maxCharsPerColumn": "-1"}


def read_quoted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV table with a header in each file as strings; line breaks in quoted cells are kept.

    Columns are taken by name, missing cells and columns are ``''``. Blank lines between
    records are skipped. A file that ends inside a quoted cell ends its last record there.
    """
    parsed = []
    for names, body in tables_of(spark, path):
        at = {name: i for i, name in reversed(list(enumerate(names)))}
        shape = ", ".join(f"c{i} string" for i in range(len(names)))
        cells = body.select(F.from_csv("record", shape, CSV_OPTIONS).alias("r"))
        pick = lambda f, at=at: F.coalesce(F.col(f"r.c{at[f.name]}"), F.lit("")) if f.name in at else F.lit("")
        parsed.append(cells.select(*[pick(f).cast(f.dataType).alias(f.name) for f in schema.fields]))
    return reduce(DataFrame.unionByName, parsed) if parsed else spark.createDataFrame([], schema)


def _cells(spark: SparkSession, header: str) -> list[str]:
    row = spark.range(1).select(F.split(F.lit(header), r',(?=(?:[^"]*"[^"]*")*[^"]*$)').alias("c")).first()
    return [c[1:-1].replace('""', '"') if len(c) > 1 and c.startswith('"') and c.endswith('"') else c for c in (x.strip() for x in row.c)]
