"""URL, host and domain Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import let, may_hold_url, refang, restore

LABEL = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_-]{0,62}"
HOST_NAME = rf"^{LABEL}(?:\.{LABEL})*\.?$"
IPV6_HOST = r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP_ADDRESS = rf"^(?:{OCTET}(?:\.{OCTET}){{3}}|[0-9a-f:.]*:[0-9a-f:.]*:[0-9a-f:.]*)$"
SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*://"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def to_ascii(host: Column) -> Column:
    """IDNA form; only hosts with other than ASCII letters pay for it."""
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike("[^\\u0000-\\u007f]"), encoded).otherwise(host)


def urls(c: Column) -> Column:
    """Links of the text in order, without the punctuation that follows them."""
    none = F.array().cast("array<string>")
    found = let(c, lambda x: F.when(may_hold_url(x), F.regexp_extract_all(x, F.lit(fv.URL), F.lit(0))).otherwise(none))
    return F.transform(found, lambda u: F.regexp_replace(u, f"{fv.URL_TAIL_PUNCTUATION}+$", ""))


def restored_urls(c: Column) -> Column:
    return urls(restore(c))


def _address(name: Column) -> Column:
    """IPv4 address of a name of one to four numbers, NULL if it is none.

    Numbers are decimal, octal with a leading zero or hexadecimal with ``0x``; the last
    one fills all bytes that are left.
    """

    def value(part: Column) -> Column:
        hexadecimal = F.regexp_extract(part, "^0[xX]0*([0-9a-fA-F]{1,8})$", 1)
        octal = F.regexp_extract(part, "^0+([1-7][0-7]{0,10})$", 1)
        return (
            F.when(part.rlike("^0+$"), F.lit(0).cast("long"))
            .when(part.rlike("^[1-9][0-9]{0,9}$"), F.try_to_number(part, F.lit("9999999999")).cast("long"))
            .when(octal != "", F.conv(octal, 8, 10).cast("long"))
            .when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        )

    def address(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        room = F.element_at(F.array(*[F.lit(256**k).cast("long") for k in (4, 3, 2, 1)]), n)
        lead = F.slice(numbers, F.lit(1), n - 1)
        good = F.forall(numbers, lambda v: v.isNotNull()) & F.forall(lead, lambda v: v <= 255) & (last < room)
        whole = F.aggregate(lead, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v) * room + last
        octets = [F.shiftright(whole, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
        return F.when(good, F.concat_ws(".", *octets))

    numeric = name.rlike(r"^[0-9][0-9a-fA-FxX]*(?:\.[0-9][0-9a-fA-FxX]*){0,3}$")
    return F.when(numeric, let(F.transform(F.split(name, r"\."), value), address))


def host(url: Column) -> Column:
    """Lower-case ASCII host of a link, NULL when the link has no valid one."""

    def checked(name: Column) -> Column:
        return let(_address(name), lambda address: (
            F.when(address.isNotNull(), address)
            .when(name.rlike(HOST_NAME), F.lower(to_ascii(name)))
            .when(name.rlike(IPV6_HOST), F.lower(F.translate(name, "[]", "")))
        ))

    authority = F.regexp_extract(F.regexp_replace(url, SCHEME, ""), r"^[^/?#\\]*", 0)
    place = F.regexp_replace(authority, "^.*@", "")

    def named(p: Column) -> Column:
        port = F.regexp_extract(p, r":(\d+)$", 1)
        good_port = (port == "") | ((F.length(port) <= 5) & (port.cast("int") <= 65535))
        name = F.regexp_extract(p, r"^(\[[^\]]*\]|[^:]*)(?::\d*)?$", 1)
        return F.when(good_port, let(name, checked))

    return let(place, named)


def domain(value: Column) -> Column:
    """Registered-domain form: lower case, no scheme, www, path or port, known ending; else NULL."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), r"\.+$", "")
    name = F.regexp_extract(F.regexp_replace(clean, r"^(?:https?://)?(?:www\.)?", ""), "^[^/:]*", 0)

    def checked(n: Column) -> Column:
        known = n.contains(".") & F.substring_index(n, ".", -1).isin(fv.DOMAIN_TLDS)
        ascii_name = let(to_ascii(n), lambda a: F.when(a.rlike(r"^[^.]{1,63}(?:\.[^.]{1,63})*$"), a))
        return F.when((F.length(n) <= fv.MAX_DOMAIN_LENGTH) & known, ascii_name)

    return let(name, checked)


def domains(c: Column) -> Column:
    """Distinct valid domains of a (possibly defanged) text, in order of appearance."""
    none = F.array().cast("array<string>")
    found = let(refang(c), lambda x: F.when(x.rlike(r"\S\.\S"), F.regexp_extract_all(x, F.lit(fv.DOMAIN), F.lit(1))).otherwise(none))
    return F.array_distinct(F.array_compact(F.transform(found, domain)))


def suffixes(host_name: Column, include_tld: bool = False) -> Column:
    """The host and its parents; ``include_tld`` adds the bare last label."""
    fewest = 1 if include_tld else 2

    def parents(h: Column) -> Column:
        count = F.size(F.split(h, r"\."))
        return F.when(
            count >= fewest,
            F.transform(F.sequence(F.lit(fewest), count), lambda k: F.call_function("substring_index", h, F.lit("."), -k)),
        ).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(host_name, r"\.+$", ""), parents)


def host_reasons(host_name: Column) -> Column:
    """Reason codes that follow from the host alone, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(host_name.isin(fv.SHORTENER_HOSTS), F.lit("url_shortener")),
            F.when(host_name.rlike(IP_ADDRESS), F.lit("url_ip_address_host")),
            F.when(host_name.rlike(r"(?:^|\.)xn--"), F.lit("url_punycode")),
            F.when(
                F.substring_index(host_name, ".", -1).isin(fv.SUSPICIOUS_TLDS), F.lit("url_suspicious_tld")
            ),
        )
    )


def skeleton(token: Column) -> Column:
    """Look-alike characters folded onto one form."""
    folded = F.replace(F.replace(F.lower(token), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(folded, "01i345", "olleas")


def fold_keyword(keyword: str) -> str:
    """``skeleton`` of a keyword list entry, for building the literals."""
    return keyword.lower().replace("rn", "m").replace("vv", "w").translate(str.maketrans("01i345", "olleas"))


def osa_within_1(a: Column, b: Column) -> Column:
    """At most one insert, delete, replace or swap of neighbours apart."""
    size = F.length(a)

    def swapped(i: Column) -> Column:
        return F.concat(
            a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, size)
        )

    swap = F.when(
        (size > 1) & (size == F.length(b)), F.exists(F.sequence(F.lit(1), size - 1), lambda i: swapped(i) == b)
    ).otherwise(False)
    near = F.levenshtein(a, b, 1) >= 0
    return (F.abs(size - F.length(b)) <= 1) & (near | swap)


def brand_like(host_name: Column, keywords: list[str] | None = None) -> Column:
    """Some part of the host looks like a brand keyword (official hosts are the caller's matter)."""
    words = fv.BRAND_KEYWORDS if keywords is None else keywords
    exact = strings([fold_keyword(w) for w in words])
    inside = [fold_keyword(w) for w in words if len(w) >= fv.BRAND_SUBSTRING_LENGTH]
    typo = [fold_keyword(w) for w in words if len(w) >= fv.BRAND_TYPO_LENGTH]
    tokens = F.transform(F.filter(F.split(host_name, "[._-]"), lambda t: t != ""), skeleton)

    def matches(token: Column) -> Column:
        hit = F.array_contains(exact, token)
        if inside:
            hit = hit | token.rlike("|".join(inside))
        if typo:
            shortest, longest = min(map(len, typo)) - 1, max(map(len, typo)) + 1
            near = F.exists(strings(typo), lambda k: osa_within_1(token, k))
            hit = hit | (F.length(token).between(shortest, longest) & near)
        return hit

    if not words:
        return F.lit(False)
    return F.coalesce(F.exists(tokens, matches), F.lit(False))


def link_facts(normalized: Column, keywords: list[str] | None = None) -> Column:
    """Links of a normalised text as ``array<struct<url, host, reasons, brand>>``.

    A link that only exists after restoring bracketed dots is obfuscated.
    """

    def fact(url: Column, literal: Column) -> Column:
        def build(h: Column) -> Column:
            hidden = F.array_compact(F.array(F.when(~F.array_contains(literal, url), F.lit("url_obfuscated"))))
            by_host = F.when(h.isNotNull(), host_reasons(h)).otherwise(F.array().cast("array<string>"))
            return F.struct(
                url.alias("url"),
                h.alias("host"),
                F.concat(hidden, by_host).alias("reasons"),
                F.when(h.isNotNull(), brand_like(h, keywords)).otherwise(False).alias("brand"),
            )

        return let(host(url), build)

    def facts(both: Column) -> Column:
        found = urls(both["restored"])
        # a text that restoring leaves alone is searched once
        literal = F.when(both["restored"] == both["text"], F.lit(None).cast("array<string>")).otherwise(urls(both["text"]))
        return let(F.struct(found.alias("found"), literal.alias("literal")), lambda x: F.transform(
            x["found"], lambda u: fact(u, F.coalesce(x["literal"], F.array(u)))
        ))

    return let(F.struct(normalized.alias("text"), restore(normalized).alias("restored")), facts)


def inspectable_link(url: Column) -> Column:
    """Web link as origin plus path, at most 500 characters; else NULL."""
    pattern = r"(?i)^(https?)://(?:[^/?#]*@)?([^/?#:\s]+)(?::(\d*))?(?=[/?#]|$)([^?#]*)"

    def part(i: int) -> Column:
        return F.regexp_extract(url, pattern, i)

    scheme = F.lower(part(1))
    port = part(3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    link = F.concat(
        scheme, F.lit("://"), F.lower(to_ascii(part(2))),
        F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(part(4) == "", F.lit("/")).otherwise(part(4)),
    )
    return let(link, lambda k: F.when((scheme != "") & (F.length(k) <= fv.MAX_LINK_LENGTH), k))


def unwrap_redirect(url: Column) -> Column:
    """Target of a known redirect link, other links as they are."""
    name = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    target = F.try_url_decode(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1))
    wrapped = name.isin(fv.REDIRECT_HOSTS) & (path == "/l.php") & (F.coalesce(target, F.lit("")) != "")
    return F.when(wrapped, target).otherwise(url)


def noisy_or(reasons: Column) -> Column:
    """Combined risk of distinct reason codes; unknown codes weigh nothing."""

    def trust(reason: Column) -> Column:
        kept = F.lit(1.0)
        for code, weight in reversed(list(fv.REASON_WEIGHTS.items())):
            kept = F.when(reason == code, F.lit(1 - weight)).otherwise(kept)
        return kept

    remaining = F.aggregate(F.array_distinct(reasons), F.lit(1.0), lambda acc, r: acc * trust(r))
    return F.lit(1.0) - remaining


def combine(probability: Column, risk: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - probability) * (F.lit(1.0) - risk)
