"""Page extraction: visible text, links, paragraphs, texts by CSS class.

A page is cut into tokens by one pattern. What is inside skipped or content
elements follows from a fold over the tokens that keeps counters and positions
only; texts are then sliced out of the token array. All of it is native but for the
decoding of entities.
"""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import collapse, let, quotes

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
RAW_ELEMENTS = ["script", "style"]
ANCHOR = r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TAG_START = r"</?[a-zA-Z]"
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]){ATTRIBUTES}(?<!/)>.*?(?:</\1\s*>|\z)|{TAG_START}[^\s/>]*{ATTRIBUTES}>|<[!?][^>]*>|[^<]+|<"
CLASS = r"(?is)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
RUNS = "array<struct<region:int,first:int,size:int>>"


def unescape(c: Column) -> Column:
    """Character references decoded once, as HTML 5 names them."""
    return F.arrow_udf(lambda texts: pa.array([_decoded(t) for t in texts.to_pylist()], pa.string()), "string")(c)


def unescape_each(c: Column) -> Column:
    """The same for every string of an array."""
    return F.arrow_udf(lambda lists: pa.array([None if x is None else [_decoded(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string())), "array<string>")(c)


def _decoded(text: str | None) -> str | None:
    return entities.unescape(text) if text and "&" in text else text


def page_tokens(html: Column) -> Column:
    """Array of ``(kind, name, classes, text)``; kinds are open, close, empty, text and none (comments, scripts and the like)."""

    def token(t: Column) -> Column:
        tag = t.rlike(f"^{TAG_START}")
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        empty = t.endswith("/>")
        raw = name.isin(RAW_ELEMENTS) & ~t.startswith("</") & ~empty
        kind = (
            F.when(tag & raw, "none").when(tag & t.startswith("</"), "close").when(tag & empty, "empty").when(tag, "open").when(t.rlike("^<[!?]"), "none").otherwise("text")
        )
        classes = F.split(F.regexp_replace(F.regexp_extract(t, CLASS, 1), "^[\"']|[\"']$", ""), r"\s+")
        return F.struct(
            kind.alias("kind"), F.when(tag, name).otherwise("").alias("name"), F.when(tag & (kind == "open"), classes).otherwise(F.array().cast("array<string>")).alias("classes"), F.when(kind == "text", t).otherwise("").alias("text")
        )

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), token)


def _step(token: Column) -> Column:
    """What an element's tag adds to the number of open elements."""
    return F.when(token["kind"] == "open", 1).when(token["kind"] == "close", -1).otherwise(0)


def _floor(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def live_runs(tokens: Column, depth: Callable[[Column, Column], Column], skipped: list[str], whole: bool = False, everywhere: bool = True) -> Column:
    """``(runs, regions)``: stretches of tokens that are inside a region and outside skipped elements.

    A region lasts while ``depth(token, depth before)`` stays above zero; ``regions``
    is how many have ended. ``whole`` makes the page one region that is open from
    the start and ends with the page. Skipped elements count ``everywhere`` or inside
    regions only.
    """
    zero = F.lit(0)
    start = F.struct(zero.alias("i"), F.lit(int(whole)).alias("depth"), zero.alias("skip"), zero.alias("region"), F.lit(0 if whole else -1).alias("since"), F.array().cast(RUNS).alias("runs"))

    def run(acc: Column, end: Column) -> Column:
        return F.concat(acc["runs"], F.array(F.struct(acc["region"].alias("region"), acc["since"].alias("first"), (end - acc["since"]).alias("size"))))

    def merge(acc: Column, token: Column) -> Column:
        deep = depth(token, acc["depth"])
        counts = token["name"].isin(skipped) & ((acc["depth"] > 0) | F.lit(everywhere))
        skip = F.when(counts, _floor(acc["skip"] + _step(token))).otherwise(acc["skip"])
        was, now = acc["since"] >= 0, (deep > 0) & (skip == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            deep.alias("depth"),
            skip.alias("skip"),
            F.when((acc["depth"] > 0) & (deep == 0), acc["region"] + 1).otherwise(acc["region"]).alias("region"),
            F.when(~now, F.lit(-1)).when(was, acc["since"]).otherwise(acc["i"] + 1).alias("since"),
            F.when(was & ~now, run(acc, acc["i"])).otherwise(acc["runs"]).alias("runs"),
        )

    def finish(acc: Column) -> Column:
        last = F.when(acc["since"] >= 0, run(acc, acc["i"])).otherwise(acc["runs"]) if whole else acc["runs"]
        return F.struct(last.alias("runs"), (acc["region"] + F.lit(int(whole))).alias("regions"))

    return F.aggregate(tokens, start, merge, finish)


def runs_outside(tokens: Column, skipped: list[str]) -> Column:
    """The same for a whole page as one region: only the tags of skipped elements are folded, which are few."""
    tags = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), _step(t).alias("step"), t["name"].isin(skipped).alias("named"))), lambda e: e["named"] & (e["step"] != 0))
    start = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("since"), F.array().cast(RUNS).alias("runs"))

    def run(acc: Column, end: Column) -> Column:
        return F.concat(acc["runs"], F.array(F.struct(F.lit(0).alias("region"), acc["since"].alias("first"), (end - acc["since"]).alias("size"))))

    def merge(acc: Column, e: Column) -> Column:
        skip = _floor(acc["skip"] + e["step"])
        begins, ends = (acc["skip"] == 0) & (skip > 0), (acc["skip"] > 0) & (skip == 0)
        return F.struct(
            skip.alias("skip"),
            F.when(begins, F.lit(-1)).when(ends, e["i"] + 1).otherwise(acc["since"]).alias("since"),
            F.when(begins, run(acc, e["i"])).otherwise(acc["runs"]).alias("runs"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(F.when(acc["since"] >= 0, run(acc, F.size(tokens))).otherwise(acc["runs"]).alias("runs"), F.lit(1).alias("regions"))

    return F.aggregate(tags, start, merge, finish)


def region_texts(tokens: Column, live: Column, render: Callable[[Column], Column], gap: str) -> Column:
    """Text of every region that has ended, in order; ``render`` gives a token's text, ``gap`` stands for what was skipped."""

    def add(out: Column, r: Column) -> Column:
        text = F.array_join(F.transform(F.slice(tokens, r["first"] + 1, r["size"]), render), "")
        last = F.element_at(out, -1)
        again = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["region"] == r["region"])
        row = lambda t: F.array(F.struct(r["region"].alias("region"), t.alias("text")))
        return F.when(again, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), row(F.concat(last["text"], F.lit(gap), text)))).otherwise(F.concat(out, row(text)))

    joined = F.aggregate(live["runs"], F.array().cast("array<struct<region:int,text:string>>"), add)
    return F.transform(F.filter(joined, lambda t: t["region"] < live["regions"]), lambda t: t["text"])


def _page_texts(html: Column, depth: Callable[[Column, Column], Column], skipped: list[str], render: Callable[[Column], Column], whole: bool = False, everywhere: bool = True, gap: str = "") -> Column:
    live = lambda tokens: runs_outside(tokens, skipped) if whole and everywhere else live_runs(tokens, depth, skipped, whole, everywhere)
    return let(page_tokens(html), lambda tokens: let(live(tokens), lambda runs: region_texts(tokens, runs, render, gap)))


def _always(token: Column, before: Column) -> Column:
    return F.lit(1)


def _held(pages: DataFrame, texts: Column) -> DataFrame:
    """``(page_id, url, texts)`` with ``texts`` as a column of its own, which a Python function can then read."""
    return pages.select("page_id", "url", F.inline(F.array(F.struct(texts.alias("texts")))))


def page_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: text outside skipped elements; tags become spaces, entities are decoded."""
    texts = _page_texts(F.col("html"), _always, fv.SKIPPED_TAGS, lambda t: F.when(t["kind"] == "text", t["text"]).when(t["kind"] == "none", "").otherwise(" "), whole=True, gap=" ")
    return _held(pages, F.array_join(texts, "")).select("page_id", "url", collapse(unescape(F.col("texts"))).alias("text"))


def _without(c: Column, elements: Iterable[str], filler: str = " ") -> Column:
    """Drop whole elements that hold no other tags; one that is never closed drops the rest."""
    for tag in elements:
        c = F.regexp_replace(c, rf"(?is)<{tag}(?=[\s/>]){ATTRIBUTES}(?<!/)>.*?(?:</{tag}\s*>|\z)", filler)
    return c


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link found on the page ``base``; dot segments are taken out of paths joined here."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.split(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/")
    above = F.slice(folder, F.lit(1), F.size(folder) - 1)  # without the page itself
    path = F.split(F.regexp_extract(link, r"^[^?#]*", 0), "/")

    def inner(parts: Column) -> Column:
        """Empty segments stay at both ends only."""
        middle = F.filter(F.slice(parts, F.lit(2), _floor(F.size(parts) - 2)), lambda s: s != "")
        return F.concat(F.slice(parts, F.lit(1), F.lit(1)), middle, F.slice(parts, F.size(parts), F.lit(1)))

    def walked(parts: Column) -> Column:
        none = F.array().cast("array<string>")
        step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), _floor(F.size(done) - 1))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
        open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.aggregate(parts, none, step), open_end)

    whole = F.when(link.startswith("/"), path).when(F.size(above) > 0, inner(F.concat(above, path))).otherwise(F.concat(F.array(F.lit("")), path))
    joined = F.regexp_replace(F.array_join(let(whole, walked), "/"), "^/?", "/")
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .otherwise(F.concat(origin, joined, tail))
    )


def page_links(pages: DataFrame, pattern: str = "", keep: Column | None = None) -> DataFrame:
    """``(page_id, pos, link)``: distinct anchors in order, resolved, matching ``pattern``."""
    clean = F.regexp_replace(_without(F.col("html"), RAW_ELEMENTS), COMMENT, "")
    found = unescape_each(F.transform(F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(1)), lambda a: F.regexp_replace(a, "^[\"']|[\"']$", "")))
    full = F.transform(F.filter(found, lambda a: a != ""), lambda a: resolve(F.col("url"), a))
    matching = F.filter(full, lambda u: u.rlike(pattern)) if pattern else full
    rows = pages.select("page_id", "url", "html") if keep is None else pages.filter(keep).select("page_id", "url", "html")
    return rows.select("page_id", F.posexplode(F.array_distinct(matching)).alias("pos", "link"))


def block_paragraphs(pages: DataFrame, outside: bool = True) -> DataFrame:
    """Paragraphs cut at every content tag; no text is lost on unclosed tags. Text that no content tag is open around counts if ``outside``."""
    cut = lambda t: F.when(t["kind"] == "text", t["text"]).when(t["name"].isin(fv.CONTENT_TAGS), _mark(t, outside)).when(t["name"] == "br", " ").otherwise("")
    texts = F.array_join(_page_texts(F.col("html"), _always, fv.SKIPPED_TAGS, cut, whole=True, gap=" "), "")
    return _long_ones(pages, F.split(texts, "\u0001") if outside else _inside(F.split(texts, "\u0001")))


def _mark(token: Column, outside: bool) -> Column:
    """A cut; where depth counts, what the tag adds to it follows."""
    return F.lit("\u0001") if outside else F.when(token["kind"] == "open", "\u0001\u0002").when(token["kind"] == "close", "\u0001\u0003").otherwise("\u0001")


def _inside(parts: Column) -> Column:
    """Parts with an open content tag around them."""

    def merge(acc: Column, part: Column) -> Column:
        depth = _floor(acc["depth"] + F.when(part.startswith("\u0002"), 1).when(part.startswith("\u0003"), -1).otherwise(0))
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(acc["out"], F.array(F.translate(part, "\u0002\u0003", "")))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out")), merge, lambda acc: acc["out"])


def depth_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs by nesting depth; an unclosed content tag swallows the rest of its page."""

    def depth(token: Column, before: Column) -> Column:
        return F.when(token["name"].isin(fv.CONTENT_TAGS), _floor(before + _step(token))).otherwise(before)

    text = lambda t: F.when(t["name"] == "br", " ").otherwise(t["text"])
    return _long_ones(pages, _page_texts(F.col("html"), depth, fv.SKIPPED_TAGS, text))


def _long_ones(pages: DataFrame, texts: Column) -> DataFrame:
    rows = _held(pages, texts).select("page_id", "url", unescape_each(F.col("texts")).alias("texts"))
    clean = F.filter(F.transform("texts", collapse), lambda p: F.length(p) >= fv.MIN_PARAGRAPH_CHARS)
    return rows.select("page_id", "url", F.posexplode(clean).alias("pos", "paragraph"))


def paragraphs(pages: DataFrame, mode: str = "depth", outside: bool = True) -> DataFrame:
    """``(page_id, url, pos, paragraph)``; ``mode`` is ``depth`` or ``block``. Only blocks hold text ``outside`` content tags, as a page's title."""
    if mode not in ("depth", "block"):
        raise ValueError("mode is depth or block")
    return depth_paragraphs(pages) if mode == "depth" else block_paragraphs(pages, outside)


def class_texts(pages: DataFrame, class_name: str) -> DataFrame:
    """``(page_id, url, pos, text)`` of the outermost elements with a CSS class; block tags break lines."""

    def depth(token: Column, before: Column) -> Column:
        counted = ~token["name"].isin(fv.VOID_TAGS)
        enters = (token["kind"] == "open") & F.array_contains(token["classes"], class_name)
        return F.when(~counted, before).when(before > 0, _floor(before + _step(token))).when(enters, 1).otherwise(0)

    breaks = ["br", *fv.BLOCK_TAGS]
    text = lambda t: F.when(t["name"].isin(breaks), "\n").otherwise(t["text"])
    rows = _held(pages, _page_texts(F.col("html"), depth, fv.CLASS_SKIPPED_TAGS, text, everywhere=False))
    rows = rows.select("page_id", "url", unescape_each(F.col("texts")).alias("texts"))

    def lines(block: Column) -> Column:
        flat = F.regexp_replace(block, r"[ \t\r\f\x0B]+", " ")
        trimmed = F.transform(F.split(flat, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")

    return rows.select("page_id", "url", F.posexplode(F.filter(F.transform("texts", lines), lambda t: t != "")).alias("pos", "text"))


def quotes_of(paragraph_rows: DataFrame) -> DataFrame:
    """``(page_id, url, pos, quote_pos, quote)`` of quoted passages."""
    return paragraph_rows.select("page_id", "url", "pos", F.posexplode(quotes(F.col("paragraph"))).alias("quote_pos", "quote"))
