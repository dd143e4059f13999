"""Text normalisation and masking as Column functions.

Everything here is a native Spark expression, so it stays on the JVM next to the
scan. Where a step reads its input more than once it is bound with ``let``,
which keeps the expression tree small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

OPEN, CLOSE = "﷐", "﷑"  # noncharacters used to fence a match between two steps
SPACES = r"(?U)(?: \s+|[\s&&[^ ]]\s*)"
PLACEHOLDER_OF = {kind: f"<{kind.upper()}>" for kind in fv.PII_KINDS}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_ascii(c: Column) -> Column:
    """One byte per character. Tests of bytes are far cheaper than any pattern, which is why they come first."""
    return F.octet_length(c) == F.length(c)


def beyond_latin(c: Column) -> Column:
    """Holds a character from U+0300 on."""
    return ~is_ascii(c) & c.rlike("[^\\u0000-\\u02ff]")


def is_plain(c: Column) -> Column:
    """Nothing to compose or to drop, and no white space but spaces and line feeds."""
    others = reduce(or_, [c.contains(x) for x in "\t\x0b\f\r\u0085\u00a0\u00ad"])
    return ~others & ~beyond_latin(c)


def nfc(c: Column) -> Column:
    """Unicode NFC; text below U+0300 is already composed and is passed through."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(beyond_latin(c), composed).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def on_one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def normalize(c: Column) -> Column:
    """NFC without invisible characters, white space collapsed; plain texts need no pattern for it."""

    def spaced(line: Column) -> Column:
        return F.trim(F.when(line.contains("  "), F.regexp_replace(line, " {2,}", " ")).otherwise(line))

    def whole(x: Column) -> Column:
        return collapse(F.regexp_replace(nfc(x), fv.INVISIBLE, ""))

    return let(c, lambda x: F.when(is_plain(x), let(on_one_line(x), spaced)).otherwise(whole(x)))


def stripped(c: Column) -> Column:
    """Text without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    visible = (c >= "!") & (c < "\x7f")  # by its first character
    return c.isNull() | (~visible & c.rlike(r"(?U)^\s*$"))


def when_may(c: Column, possible: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """Run a costly step only on texts that pass a cheap test, which every affected text passes."""
    return let(c, lambda x: F.when(possible(x), step(x)).otherwise(x))


def restore(c: Column) -> Column:
    """Undo bracketed dots and defanged schemes; keeps http and https apart."""

    def bracketed(x: Column) -> Column:
        return (x.contains("[") | x.contains("(") | x.contains("{")) & x.rlike(r"(?iuU)[\[({]\s?(?:\.|dot|ch)")

    dotted = when_may(c, bracketed, lambda x: F.regexp_replace(x, fv.BRACKETED_DOT, "."))
    return when_may(dotted, lambda x: x.contains("//"), lambda x: F.regexp_replace(x, fv.DEFANGED_SCHEME, "http$1://"))


def refang(c: Column) -> Column:
    """The looser rule set of the crawl side: any defanged scheme becomes https."""
    dotted = F.regexp_replace(c, fv.DEFANGED_DOT, ".")
    return F.regexp_replace(F.regexp_replace(dotted, fv.DEFANGED_HXXP, "https"), fv.DEFANGED_COLON, ":")


def mask_email(c: Column) -> Column:
    return when_may(c, lambda x: x.contains("@"), lambda x: F.regexp_replace(x, fv.EMAIL, "<EMAIL>"))


def may_hold_url(c: Column) -> Column:
    """A scheme, or a dot between two other characters; dots before a space or the end are left out first."""
    inner_dot = F.replace(F.concat(c, F.lit(" ")), F.lit(". "), F.lit("")).contains(".")
    return c.contains("://") | (inner_dot & c.rlike(r"\S\.\S"))


def mask_url(c: Column) -> Column:
    """URLs become ``<URL>``; punctuation at their end stays in the text."""
    tail = f"{OPEN}[^{OPEN}{CLOSE}]*?({fv.URL_TAIL_PUNCTUATION}*){CLOSE}"

    def replaced(x: Column) -> Column:
        fenced = F.regexp_replace(F.translate(x, OPEN + CLOSE, ""), fv.URL, f"{OPEN}$0{CLOSE}")
        return F.regexp_replace(fenced, tail, "<URL>$1")

    return when_may(c, may_hold_url, replaced)


def mask_otp(c: Column) -> Column:
    return F.regexp_replace(c, fv.OTP, "<OTP>")


def mask_id(c: Column) -> Column:
    return F.regexp_replace(c, fv.ID_NUMBER, "<ID>")


def mask_phone(c: Column) -> Column:
    return F.regexp_replace(c, fv.PHONE, "<PHONE>")


def mask_account(c: Column) -> Column:
    return F.regexp_replace(c, fv.ACCOUNT, "<ACCOUNT>")


def _mask_numbers(c: Column) -> Column:
    return when_may(c, lambda x: x.rlike(r"\p{Nd}"), lambda x: mask_account(mask_phone(mask_id(mask_otp(x)))))


def _mask_restored(restored: Column) -> Column:
    return _mask_numbers(mask_url(mask_email(restored)))


def mask(c: Column) -> Column:
    """Restore links, then mask e-mail, URL, OTP, ID, phone and account in this order."""
    return _mask_restored(restore(c))


def mask_normalized(c: Column) -> Column:
    return mask(normalize(c))


def pii_kinds(c: Column) -> Column:
    """Names of the masking steps that find something, in step order.

    A step leaves one placeholder per match and no later step takes one away, so
    the step worked iff the text gained placeholders of its kind.
    """

    def found(both: Column) -> Column:
        def count(text: str, kind: str) -> Column:
            return F.regexp_count(both[text], F.lit(PLACEHOLDER_OF[kind]))

        return F.array_compact(
            F.array(*[F.when(count("after", k) > count("before", k), F.lit(k)) for k in fv.PII_KINDS])
        )

    return let(
        restore(c), lambda r: let(F.struct(r.alias("before"), _mask_restored(r).alias("after")), found)
    )


def has_url(c: Column) -> Column:
    return c.contains("<URL>") | restore(c).rlike(fv.URL)


def may_contain_name(c: Column) -> Column:
    """An honorific followed by a word that starts with a capital letter."""
    words = F.regexp_extract_all(c, F.lit(fv.HONORIFIC), F.lit(1))
    return F.exists(words, lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))


def duplicate_text(c: Column) -> Column:
    """Form in which two texts count as the same text."""
    return F.lower(collapse(c))


def text_key(c: Column) -> Column:
    return F.substring(F.sha2(duplicate_text(c), 256), 1, fv.KEY_HEX)


def _clean_kept_url(url: Column) -> Column:
    """A readable link without user part, query and fragment, its numbers masked."""
    bare = F.regexp_replace(F.regexp_replace(url, fv.URL_USER_PART, "$1"), fv.URL_QUERY_AND_FRAGMENT, "")
    return mask_account(mask_phone(bare))


def mask_keep_urls(c: Column) -> Column:
    """Client-side variant: links stay readable, their secrets go.

    Text is cut into link and non-link parts, so number rules never look into a
    link and no rule reaches across one.
    """

    def parts(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"({OPEN}[^{CLOSE}]*{CLOSE}|[^{OPEN}]+)"), F.lit(1))

    def outside(part: Column, body: Callable[[Column], Column]) -> Column:
        return F.when(part.startswith(OPEN), part).otherwise(body(part))

    fence = f"{OPEN}$0{CLOSE}"
    visible = F.regexp_replace(nfc(c), f"[\\u0000{OPEN}{CLOSE}]|{fv.INVISIBLE}", "")
    with_scheme = F.regexp_replace(visible, fv.SCHEME_URL, fence)
    with_all = F.array_join(
        F.transform(
            parts(with_scheme),
            lambda p: outside(p, lambda t: F.regexp_replace(mask_email(t), fv.BARE_DOMAIN, fence)),
        ),
        "",
    )
    cleaned = F.transform(
        parts(with_all),
        lambda p: F.when(p.startswith(OPEN), _clean_kept_url(F.translate(p, OPEN + CLOSE, ""))).otherwise(
            _mask_numbers(p)
        ),
    )
    return F.array_join(cleaned, "")


def evidence_excerpt(c: Column) -> Column:
    """Masked paragraph, cut to the evidence length with an ellipsis."""
    limit = fv.MAX_EVIDENCE_CHARS
    return let(
        template_text(c),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…"))),
    )


def template_text(c: Column) -> Column:
    return mask(normalize(refang(c)))


def parse_code(c: Column, allowed: list[str]) -> Column:
    """Trimmed, case-insensitive enum value or NULL."""
    name = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin(allowed), name)


def parse_label(c: Column) -> Column:
    return parse_code(c, fv.LABELS)


def parse_report_channel(c: Column) -> Column:
    return parse_code(c, fv.REPORT_CHANNELS)


def message_error(raw: Column, normalized: Column) -> Column:
    """Error code of a message that cannot be scored, NULL when it can."""
    return F.when(is_blank(raw), F.lit("classification.empty_text")).when(
        F.length(normalized) > fv.MAX_MESSAGE_LENGTH, F.lit("classification.text_too_long")
    )


def surely_too_long(c: Column) -> Column:
    """The first characters alone show that the normalised text is longer than a message may be.

    Either ``normalize`` leaves the length of all of them alone, but for a space at either end: they are
    plain, and no white space stands next to white space. Or they hold enough ASCII letters, of
    which no step drops one or joins two.
    """
    limit = fv.MAX_MESSAGE_LENGTH
    start = F.substring(c, 1, limit + 3)
    plain = (F.length(c) >= limit + 3) & let(start, lambda x: ~on_one_line(x).contains("  ") & is_plain(x))
    letters = F.regexp_replace(F.substring(c, 1, 2 * limit), "[^A-Za-z]+", "")
    return F.coalesce((F.length(c) > limit) & (plain | (F.length(letters) > limit)), F.lit(False))


def contains_keyword(c: Column, keywords: list[str] | Column | None = None) -> Column:
    """Lower-cased text holds any keyword; an empty list means the default one."""
    default = F.array(*[F.lit(k) for k in fv.WARNING_KEYWORDS])
    if isinstance(keywords, Column):
        words = F.when(F.size(keywords) > 0, F.transform(keywords, F.lower)).otherwise(default)
    elif keywords:
        words = F.array(*[F.lit(k.lower()) for k in keywords])
    else:
        words = default
    return let(F.lower(c), lambda t: F.exists(words, lambda k: t.contains(k)))


def is_warning(c: Column) -> Column:
    return c.rlike(fv.WARNING_CONTEXT)


def has_vietnamese_letter(c: Column) -> Column:
    return c.rlike(fv.VIETNAMESE_LETTER)


def quotes(c: Column) -> Column:
    """Quoted passages of 30 to 600 characters, in order."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(fv.QUOTE), F.lit(1)),
        lambda q: F.regexp_replace(q, r"(?U)^\s+|\s+$", ""),
    )


def is_page_block(c: Column) -> Column:
    low, high = fv.PAGE_BLOCK_CHARS
    return F.length(collapse(c)).between(low, high)
