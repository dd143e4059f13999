"""Main text of pages by site style trees.

The trees of a host's pages are merged by the presentation (tag and names) of the
elements on the way from the root. For each merged element two entropies tell how
much its occurrences differ, on a scale from 0 to 1 (logarithm to the base of their
number; 1 for an element that occurs once):

* presentation: of the sequences of its children's presentations,
* content: of its own text blocks.

A block's importance is ``CONTENT_SHARE`` of its element's content entropy and, for the
rest, the largest presentation entropy of the elements around it, so what a template
repeats comes out low and what varies comes out high. Blocks below ``LEAST`` are noise,
and a branch that holds nothing else goes.

Entropy can't see boilerplate whose words are new on every page (an advert, the end
of a footer), so names of elements weigh in as a prior; it is 0 in branches named as
menus, headers, footers, sidebars, notices, adverts, forms or comments, ``NAMED`` in branches
named as content, 0 outside ``article`` and ``main`` on a page that has them, and 1/2
elsewhere: ``PRIOR * prior + (1 - PRIOR) * importance`` has to reach ``LEAST``.

So a name alone keeps no text: a block of an article goes where its element says the same
on (nearly) every page of the host and has the same layout there, such as a notice without
a telling name. The article's own layout speaks for the article, not for its parts. Names
do decide alone for headings, which may name a section, and for elements that have fewer than
``ENOUGH`` texts.

Scripts, styles and markup are never text. What repeats inside one page counts once
there, and pages of a host that differ in branches named as noise only count once, so
copies don't make an article look like a template. Observations are combined in
the tasks before they are shuffled, so a hot host sends few rows. The entropies go to
the tasks as sorted arrays where they have at most ``KNOWN`` rows, else by joins.

Null and empty pages have the empty text. A null address has the empty host. Repeated
rows and ids each get their own answer. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import CONTENT, CONTENT_TAGS, HEAD, NOISE, Page, digest, parse
from .tables import stored

CONTENT_SHARE = 0.7
PRIOR = 0.6
LEAST = 0.5
NAMED = 0.83  # prior of content by name: an importance of 0.005 has to come to it
ENOUGH = 20
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KNOWN = 2_000_000  # merged elements, 32 bytes each

Entropies = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # paths -> presentation, content, number of texts


def host_of(url: Column) -> Column:
    """Between ``://`` and the next slash, question mark or hash, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1), F.lit("")))


def observations(page: Page) -> list[tuple[int, bool, int]]:
    """``(path, content, value)``: children's presentations of each element, and its text blocks; equal ones once a page."""
    styles = [(e.path, False, digest(np.array(e.style, np.int64).tobytes())) for e in page.elements]
    return list(dict.fromkeys(styles + [(page.elements[owner].path, True, digest(text)) for owner, text in page.blocks]))


def priors(page: Page) -> list[float]:
    """Prior of each element from the names on its way up."""
    elements = page.elements
    holds = [e.name in CONTENT_TAGS for e in elements]  # an article or main part is in it
    texts = [e.texts > 0 for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] |= holds[i]
        texts[elements[i].parent] |= texts[i]
    out, named = [0.5] * len(elements), False
    for i, e in enumerate(elements[1:], 1):
        above = out[e.parent]
        frame = holds[i] and e.name in ("div", "section") and not e.talk  # names of a frame around the article don't count
        if above == 0:
            out[i] = 0.0
        elif e.mark == NOISE:
            out[i] = above if frame else 0.0
        elif e.mark == HEAD:
            out[i] = above if frame or above >= NAMED else 0.0
        elif e.mark == CONTENT:
            out[i] = NAMED
            named |= e.name in CONTENT_TAGS and texts[i]
        else:
            out[i] = 1.0 if above == NAMED and e.name in HEADINGS else above
    return [0.0 if named and p == 0.5 else p for p in out]


def signature(page: Page, host: str) -> int:
    """Of the host and the texts that are in no branch named as noise."""
    prior = priors(page)
    return digest("\n".join([host, *(text for owner, text in page.blocks if prior[owner] > 0)]))


def main_blocks(page: Page, entropies: Entropies) -> list[str]:
    """The text blocks that stay, in page order."""
    elements = page.elements
    style, content, texts = entropies(np.array([e.path for e in elements], np.int64))
    around = style.copy()
    around[0] = 0.0
    for i, e in enumerate(elements[1:], 1):
        if e.name in ("html", "body"):
            around[i] = 0.0
        elif elements[e.parent].mark != CONTENT:
            around[i] = max(around[i], around[e.parent])
    importance = CONTENT_SHARE * content + (1 - CONTENT_SHARE) * around
    prior = np.array(priors(page))
    prior[(prior == NAMED) & (texts < ENOUGH)] = 1.0
    stays = PRIOR * prior + (1 - PRIOR) * importance >= LEAST - 1e-9
    return [text for owner, text in page.blocks if stays[owner]]


OBSERVED = "page long, seen array<struct<path:long,content:boolean,value:long>>"
_SEEN = pa.list_(pa.struct([("path", pa.int64()), ("content", pa.bool_()), ("value", pa.int64())]))


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, hosts, bodies = (batch.column(c) for c in ("page", "host", "body"))
        for i in range(len(batch)):
            page = parse(bodies[i].as_py() or "", hosts[i].as_py())
            seen, sign = observations(page), pa.array([signature(page, hosts[i].as_py())], pa.int64())
            path, content, value = (pa.array([s[k] for s in seen], _SEEN.value_type[k].type) for k in range(3))
            rows = pa.StructArray.from_arrays([path, content, value], fields=list(_SEEN.value_type))
            yield pa.RecordBatch.from_arrays([sign, pages.slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["sign", "page", "seen"])


def site_tree(seen: DataFrame) -> DataFrame:
    """``(path, style, content, texts)``: entropies of the merged elements that occur more than once, and their number of texts."""
    each = seen.select(F.explode("seen").alias("s")).groupBy("s.path", "s.content", "s.value").agg(F.count("*").alias("k"))
    m, spread = F.sum("k"), F.sum(F.col("k") * F.ln("k"))
    sums = each.groupBy("path", F.col("content").alias("of_text")).agg(m.cast("double").alias("m"), spread.alias("spread"))
    entropy = (F.ln("m") - F.col("spread") / F.col("m")) / F.ln("m")
    told = sums.filter("m > 1").groupBy("path")
    of = lambda text, value: F.max(F.when(F.col("of_text") == text, value))
    return told.agg(of(False, entropy).alias("style"), of(True, entropy).alias("content"), F.coalesce(of(True, F.col("m")), F.lit(0.0)).alias("texts"))


def _lookup(paths: np.ndarray, style: np.ndarray, content: np.ndarray, texts: np.ndarray) -> Entropies:
    """Entropies from sorted arrays; 1 for elements that aren't there."""

    def run(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(paths):
            return np.ones(len(asked)), np.ones(len(asked)), np.ones(len(asked))
        at = np.minimum(np.searchsorted(paths, asked), len(paths) - 1)
        hit = paths[at] == asked
        return np.where(hit, style[at], 1.0), np.where(hit, content[at], 1.0), np.where(hit, texts[at], 1.0)

    return run


def _arrays(rows: pa.Table | pa.RecordBatch | pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    read = (lambda c: rows.field(c)) if isinstance(rows, pa.StructArray) else (lambda c: rows.column(c))
    path = np.asarray(read("path")).astype(np.int64)
    style, content, texts = (np.nan_to_num(np.asarray(read(c).cast(pa.float64())).astype(float), nan=1.0) for c in ("style", "content", "texts"))
    order = np.argsort(path)
    return path[order], style[order], content[order], texts[order]


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", known: int = KNOWN) -> DataFrame:
    """``(row, host, blocks)`` of every input row: the blocks of its main text, in order.

    ``id_col`` only names the table's key; pages are told apart by host and body.
    """
    url, body = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(url).alias("host"), body.alias("body"))
    given = given.withColumn("page", F.xxhash64("host", "body"))
    seen = given.select("page", "host", "body").mapInArrow(_observe, f"sign long, {OBSERVED}")
    seen = stored(seen.groupBy("page").agg(F.any_value("sign").alias("sign"), F.any_value("seen").alias("seen")), "seen")
    firsts = seen.groupBy("sign").agg(F.min("page").alias("page"))
    tree = stored(site_tree(seen.join(firsts, "page", "left_semi")), "tree")
    if tree.count() <= known:
        shared = pages.sparkSession.sparkContext.broadcast(_arrays(tree.toArrow().combine_chunks()))  # at most `known` rows of 32 bytes

        def run(bodies: pa.Array, hosts: pa.Array) -> pa.Array:
            entropies = _lookup(*shared.value)
            return pa.array([main_blocks(parse(b.as_py() or "", h.as_py()), entropies) for b, h in zip(bodies, hosts)], pa.list_(pa.string()))

        return given.select("row", "host", F.arrow_udf(run, "array<string>")("body", "host").alias("blocks"))

    def run_joined(bodies: pa.Array, hosts: pa.Array, trees: pa.Array) -> pa.Array:
        every = (_lookup(*_arrays(t.values)) if t.is_valid else _lookup(*[np.zeros(0)] * 4) for t in trees)
        return pa.array([main_blocks(parse(b.as_py() or "", h.as_py()), e) for b, h, e in zip(bodies, hosts, every)], pa.list_(pa.string()))

    paths = seen.select("page", F.explode(F.array_distinct(F.transform("seen", lambda s: s["path"]))).alias("path"))
    own = stored(paths.join(tree, "path").groupBy("page").agg(F.collect_list(F.struct("path", "style", "content", "texts")).alias("own")), "own")
    return given.join(own, "page", "left").select("row", "host", F.arrow_udf(run_joined, "array<string>")("body", "host", "own").alias("blocks"))
