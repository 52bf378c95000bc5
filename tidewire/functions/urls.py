"""URL functions."""

from __future__ import annotations

import functools
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only say where a click came from; hosts that wrap links in a redirect.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "cmpid", "ocid", "amp", "outputtype", "_ga", "s_cid")
REDIRECTS = ("bing.com", "google.com", "news.google.com")
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|gif)$"
#: Words that the names of pictures have which show nothing of a story: marks of the site, faces, fillers, advertisements.
SITE_MARKS = ("logo", "icon", "favicon", "badge", "emoji", "sprite")
FACES = ("avatar", "gravatar")
FILLERS = ("placeholder", "spacer", "pixel", "tracking")
#: Pairs of words that together say so, written apart or as one.
PAIRS = (("default", "image"), ("default", "share"), ("default", "og"), ("banner", "ad"))


def normalized(url: str | None, base: str | None = None) -> str | None:
    """The canonical form of a web address, or None if it is none: host in lower case, without default port, fragment, AMP ending, doubled slashes and tracking, its query sorted."""
    try:
        at = urlsplit(urljoin(base, url.strip()) if base else (url or "").strip())
        host, port = (at.hostname or "").lower().rstrip("."), at.port
    except (ValueError, AttributeError):
        return None
    if at.scheme.lower() not in ("http", "https") or "." not in host:
        return None
    where = host if port in (None, 80, 443) else f"{host}:{port}"
    path = re.sub(r"(?<=.)/amp(/?)$", r"\1", at.path or "/") or "/"
    pairs = sorted(p for p in parse_qsl(at.query, keep_blank_values=True) if not p[0].lower().startswith("utm_") and p[0].lower() not in TRACKING)
    return urlunsplit((at.scheme.lower(), where, re.sub("/{2,}", "/", path), urlencode(pairs), ""))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """`normalized` as a column. Addresses that are plain already stay in the JVM."""

    @F.pandas_udf("string")
    def g(urls: pd.Series, bases: pd.Series) -> pd.Series:
        known: dict[tuple, str | None] = {}
        out = []
        for key in zip(urls, bases, strict=True):
            if key not in known:
                known[key] = normalized(*key) if key[0] is not None else None
            out.append(known[key])
        return pd.Series(out, dtype=object)

    # host in lower case, path of plain characters without doubled slashes or AMP ending, nothing behind it
    plain = F.coalesce(url.rlike(r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)+(/[A-Za-z0-9._~%-]+)*/?$") & ~url.rlike("/amp/?$"), F.lit(False))
    whole = F.when(url.rlike("^https?://[^/]+$"), F.concat(url, F.lit("/"))).otherwise(url)
    return F.when(plain, whole).otherwise(g(F.when(~plain, url), F.lit(None).cast("string") if base is None else base))


def match_key(url: Column) -> Column:
    """What all spellings of a normalised address share: without scheme, leading www and closing slash. One equi-join instead of eight spellings."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?", ""), r"/+(?=\?|$)", "")


def variants(url: Column) -> Column:
    """The spellings of a normalised address: either scheme, with and without www, with and without closing slash."""
    rest = F.regexp_replace(url, r"^https?://(www\.)?", "")
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"(?<=[^/])/+$", "")
    root = ~path.contains("/") | path.endswith("/")
    bare = F.regexp_replace(path, "/$", "")
    ends = F.when(root, F.array(F.lit("/"))).otherwise(F.array(F.lit(""), F.lit("/")))
    heads = F.array(*(F.lit(s + w) for s in ("http://", "https://") for w in ("", "www.")))
    return F.array_sort(F.flatten(F.transform(heads, lambda h: F.transform(ends, lambda e: F.concat(h, bare, e, query)))))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def site_of(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(host_of(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")


def same_site(url: Column, other: Column) -> Column:
    return site_of(url) == site_of(other)


def unwrap_redirect(url: Column) -> Column:
    """The address that a news search's redirect carries in its url parameter, else the address itself."""
    host = host_of(url)
    wrapped = F.lit(False)
    for h in REDIRECTS:
        wrapped = wrapped | (host == h) | host.endswith("." + h)
    target = F.try_url_decode(F.regexp_extract(url, r"[?&]url=([^&#]*)", 1))
    return F.when(wrapped & target.rlike("^https?://"), target).otherwise(url)


def url_words(url: Column) -> Column:
    """The words of an address's path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "/-_", "   ")


def looks_like_article(url: Column) -> Column:
    """A path with a year and a month, or a last segment of at least 20 characters with three hyphens, without its ending."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dated = F.exists(F.zip_with(parts, F.slice(parts, 2, 1 << 20), lambda y, m: F.coalesce(y.rlike(r"^(19|20)\d\d$") & m.rlike(r"^\d\d?$"), F.lit(False))), lambda x: x)
    name = F.substring_index(F.try_element_at(parts, F.lit(-1)), ".", 1)
    return (F.size(parts) > 0) & (dated | ((F.size(F.split(name, "-", -1)) > 3) & (F.length(name) >= 20)))


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf"), F.lit(False))


def shows_nothing(url: Column) -> Column:
    """Whether the words of a picture's address say that it is a logo, an icon, a placeholder, an advertisement or a drawing of the site."""
    low = F.lower(url)
    path = F.regexp_replace(low, r"[?#].*$", "")
    words = F.filter(F.split(path, "[^a-z]+"), lambda w: w != "")
    telling = functools.reduce(Column.__or__, [low.contains(w) for w in (*SITE_MARKS, *FACES, *FILLERS)])
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    pairs = functools.reduce(Column.__or__, [joined.contains(f"{a} {b}") | joined.contains(a + b) for a, b in PAIRS])
    folder = F.exists(F.slice(F.split(path, "/"), 2, 1 << 20), lambda part: part.isin("ad", "ads"))
    return telling | pairs | folder | low.contains("blank.") | path.endswith(".svg")


def usable_image(url: Column) -> Column:
    """The normalised address of an image that isn't a logo or placeholder, else null."""
    u = normalize_url(url)
    return F.when(~shows_nothing(u), u)


def safe_url(url: Column) -> Column:
    """The address if it is a web address, else null."""
    return F.when(F.lower(F.split(F.trim(url), ":")[0]).isin("http", "https"), F.trim(url))


def domain(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


#: A path that stands behind its site as it is.
PLAIN_PATH = re.compile(r"/[A-Za-z0-9_~%/ .-]*(?:\?[A-Za-z0-9_~%/ .=&-]*)?")


def _origin(base: str) -> str:
    """Scheme and host of an address of the web, else nothing."""
    parts = urlsplit(base)
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme in ("http", "https") and parts.netloc else ""


def absolute_link(href: str | None, base: str) -> str | None:
    """A link as an absolute address without fragment, blanks escaped; None for what isn't a page of the web."""
    target = (href or "").strip().partition("#")[0]
    if not target:
        return None
    try:
        plain = PLAIN_PATH.fullmatch(target) and "//" not in target and "/." not in target and target[-1] != "?"
        full = _origin(base) + target if plain and _origin(base) else urljoin(base, target)
        return full.replace(" ", "%20") if urlsplit(full).scheme in ("http", "https") else None
    except ValueError:
        return None


def page_url(path: str, **params) -> str:
    """A page's own address: empty parameters and page=1 left out."""
    kept = {k: v for k, v in params.items() if v not in (None, "") and not (k == "page" and int(v) == 1)}
    return path + ("?" + urlencode(kept) if kept else "")


def excluded(url: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is found in the address, regardless of case."""
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(f"(?i){p}")
    return out


UUID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def path_shape(url: Column) -> Column:
    """The form of a path: dates, years, numbers, identifiers and long names by what they are, other segments as they stand."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def shaped(segment: Column) -> Column:
        def told(s: Column) -> Column:
            slug = (F.size(F.split(s, "-", -1)) > 3) & ~s.contains("{uuid}")
            number = F.when(s.rlike(r"^(19|20)\d\d$"), "{year}").otherwise("{n}")
            return F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), "{date}").when(s.rlike(r"^\d+$"), number).when(slug, F.concat(F.lit("{slug}"), F.regexp_extract(s, r"(\.\w+)$", 1))).otherwise(F.regexp_replace(s, r"\d{5,}", "{id}"))

        return F.transform(F.array(F.regexp_replace(segment, f"(?i){UUID}", "{uuid}")), told)[0]

    parts = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), shaped)
    end = F.when(path.endswith("/") & (F.size(parts) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(parts, "/"), end)
