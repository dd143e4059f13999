"""Costly texts are made once, however many steps read them."""

from pyspark.sql import functions as F

from siftwave.operators.ids import row_numbers
from siftwave.functions import fixed_values as fv
from siftwave.functions import similarity, text
from siftwave.plans import curation, scoring


def counted(spark, n, lead="Xin chào bạn, đây là tin nhắn thử nghiệm "):
    """Rows whose text is made by a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def text(i):
        calls.add(1)
        return lead + "abcdefghij"[i % 10] * 5

    return spark.range(n).select(F.col("id").alias("ord"), F.udf(text, "string")("id").alias("text")), calls


def test_rows_are_numbered_without_making_them_twice(spark):
    rows, calls = counted(spark, 50)
    assert [r.n for r in row_numbers(rows, [F.col("ord")]).orderBy("ord").collect()] == list(range(50)) and calls.value == 50


def test_offers_are_masked_once(spark):
    rows, calls = counted(spark, 50)
    done = curation.collect_outcomes(rows, spark.createDataFrame([], "key string")).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in done} == {"added": 10, "duplicate": 40} and calls.value == 50


def test_messages_are_read_once_for_links_and_templates(spark):
    rows, calls = counted(spark, 50)
    templates = spark.createDataFrame([("t1", "Xin chào bạn, đây là tin nhắn thử nghiệm aaaaa")], "id string, text string")
    listed = spark.createDataFrame([("bad.example",)], "domain string")
    done = scoring.score_messages(rows.withColumnRenamed("ord", "msg_id"), scoring.Intel(listed, listed, templates)).collect()
    assert len(done) == 50 and all(r.label == "scam" for r in done) and calls.value == 50


def test_texts_that_are_surely_too_long(spark):
    texts = ["a" * 2001, "a" * 2000, " a" * 2000, "a  " * 2001, "a\u200b" * 2000, "a\u0301" * 2000, "A\u0301" * 2001, "é" * 2001, "\u1100\u1161" * 2000, "1" * 2001, "", " " * 5000, None, "-" * 4001 + "b"]
    texts += [" " + "é" * n + " " + tail for n in (1999, 2000, 2001) for tail in ("", " ", "\u200b ", "é", "\u0301")] + ["1 " * 1000 + end for end in ("", "1", " 1", "1 ", "12", "\u00a02")]
    texts += ["é" * 1999 + x + "é" for x in ("  ", "\t\n", "\u0085 ", "\u00a0\u00a0", "\x1c ", "\u00ad\u00ad", "\u0301\u0301", "\u3000 ")] + ["é" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    plain = text.message_error(F.col("text"), text.normalize(F.col("text")))
    want = {r.msg_id: r.error for r in rows.select("msg_id", plain.alias("error")).collect()}
    got = {r.msg_id: (r.error, r.normalized) for r in scoring.prepared(rows).collect()}
    assert {i: e for i, (e, _) in got.items()} == want
    assert got[len(texts) - 1][1] is None and got[0] == ("classification.text_too_long", None) and got[5] == (None, "á" * 2000)  # not normalised, normalised


LATIN = [chr(i) for i in range(1, 0x300)]
ODD = ["", " ", "\n", " a", "a\n", "a  b", "a \n b", "a\n\n\nb ", "\ta", "a\u00a0b", "\u0085", "e\u0301", "a\u200bb", "tiếng Việt", "\u1100\u1161", "\U0001f600 a", "İstanbul Iı", "x İ <URL> Y", "<URL> Ab", "<ab> é", "ÀÉ_b 1²3 ªº ÷x", None]
ODD += ["a.b", "a. b", "a .b", ". a", "a.", "a..", "a.\nb", "a.\tb", "..", "x://", "a. b.c", ".a", "a. . b", "x(.)y", "x [DOT] y", "x{chấm}y", "x (dot y", "(a) b", "x(\u00a0.\u00a0)y", "x [cham] y"]
ODD += [a + x + b for x in LATIN for a, b in (("", ""), ("a", "B"), (" ", "\n"))]


def test_byte_tests_leave_results_as_the_patterns_give_them(column):
    """Normalising, blank texts, tokens, links and brackets: gates of bytes against the plain patterns."""
    assert column(text.normalize, ODD) == column(lambda c: text.collapse(F.regexp_replace(text.nfc(c), fv.INVISIBLE, "")), ODD)
    assert column(text.is_blank, ODD) == column(lambda c: c.isNull() | c.rlike(r"(?U)^\s*$"), ODD)
    assert column(text.may_hold_url, ODD) == column(lambda c: c.contains("://") | c.rlike(r"\S\.\S"), ODD)
    assert column(text.restore, ODD) == column(lambda c: F.regexp_replace(F.regexp_replace(c, fv.BRACKETED_DOT, "."), fv.DEFANGED_SCHEME, "http$1://"), ODD)
    runs = lambda c: F.regexp_extract_all(text.nfc(c), F.lit(fv.TOKEN), F.lit(1))
    assert column(similarity.tokens, ODD) == column(lambda c: F.transform(runs(c), lambda t: F.when(t.startswith("<"), t).otherwise(F.lower(t))), ODD)


def test_plain_texts_meet_no_pattern_of_white_space(column, monkeypatch):
    """They stay the same when the costly patterns would do harm, so these don't run on them."""
    monkeypatch.setattr(text, "SPACES", "[a-z]")
    monkeypatch.setattr(fv, "INVISIBLE", "[a-z]")
    monkeypatch.setattr(fv, "TOKEN", "(q)")
    assert column(text.normalize, [" Mót\nline  of text\n", "plain"]) == ["Mót line of text", "plain"]
    assert column(similarity.tokens, ["Two Words", "Ünlike Été"]) == [["two", "words"], ["ünlike", "été"]]
