"""Quoted CSV read by many tasks against the one-task scan."""

import random

from pyspark.sql import functions as F

from siftwave import schemas
from siftwave.sources import quoted, tables

SHAPE = schemas._strings("id text note")


def rows(n: int) -> list[tuple]:
    r = random.Random(5)
    cell = lambda: "".join(r.choice(["a", "é", '"', "\n", ",", "\r\n", " ", "x" * 30]) for _ in range(r.randint(0, 25)))
    return [(f"k{i}", cell(), cell()) for i in range(n)] + [("long", '"\n' * 3000 + "end", "z" * 5000), ("last", "", "\n")]


def written(path, data, header="id,text,note"):
    q = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
    path.write_bytes(("\n".join([header, *[",".join(map(q, row)) for row in data]]) + "\n").encode())


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    data = rows(700)
    written(tmp_path / "one.csv", data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path / "one.csv")
        assert quoted.lines(spark, path).rdd.getNumPartitions() >= 8
        got = quoted.read_quoted(spark, path, SHAPE).collect()
        inside = quoted.blocks(quoted.lines(spark, path)).filter("inside").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert inside > 3
    norm = lambda v: v.replace("\r\n", "\n")  # noqa: E731  (the CSV parser reads either as one line break)
    same = lambda found: sorted((a, norm(b), norm(c)) for a, b, c in found)
    assert same(got) == same(data)
    assert same(tables.read_table(spark, path, SHAPE, multi_line=True).collect()) == same(data)


def test_folders_headers_and_odd_files(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    written(folder / "a.csv", [("1", "x\ny", "n")])
    written(folder / "b.csv", [("n2", "2")], header="note,id")
    (folder / "c.csv").write_bytes("﻿id,text,note\r\n3,plain,\r\n\r\n4,\"a,\"\"b\"\"\",q\r\n".encode())
    (folder / "d.csv").write_bytes(b"")
    (folder / "e.csv").write_bytes(b"id,text,note\n5,\"never closed\nat all")
    got = {tuple(r) for r in quoted.read_quoted(spark, str(folder), SHAPE).collect()}
    assert got == {("1", "x\ny", "n"), ("2", "", "n2"), ("3", "plain", ""), ("4", 'a,"b"', "q"), ("5", "never closed\nat all", "")}


def test_only_pieces_are_shuffled(spark, tmp_path):
    written(tmp_path / "one.csv", rows(50))
    found = quoted.records(spark, str(tmp_path / "one.csv"))
    assert found.filter(F.col("record").isNull()).count() == 0
    assert tables.read_table(spark, str(tmp_path / "one.csv"), SHAPE).count() == 52
