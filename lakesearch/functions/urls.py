"""URL expressions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track visitors.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid",
    "ref", "spm", "source", "from", "share_token", "sns",
]

# Path endings that are never pages.
SKIP_ENDINGS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".7z", ".tar", ".gz",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".wav",
    ".exe", ".dmg", ".apk", ".ipa",
    ".css", ".js", ".json", ".xml", ".rss", ".woff", ".woff2", ".ttf",
]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    """The part between // and the path, in lower case, port included."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """The authority without user and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def site(url: Column) -> Column:
    """The host without a leading www.; null for a null url."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def _recode(text: Column) -> Column:
    """Percent-decoded and encoded again, with + for a blank; what can't be decoded stays as it is."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(text: Column) -> Column:
    """The query string without tracking pairs: order kept, blank values kept, pairs encoded in one way."""

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        name, value = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p), F.when(at > 0, F.substr(p, at + 1)).otherwise(F.lit(""))
        return F.concat(_recode(name), F.lit("="), _recode(value))

    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))).isin(TRACKING_KEYS))
    return F.array_join(F.transform(kept, pair), "&")


def normalize(url: Column, legacy_port: bool = False) -> Column:
    """One spelling per address; '' where the scheme is not http or https.

    Lower case of scheme and authority, no fragment, no default port, no tracking pairs, no slash at the end.
    `legacy_port` removes ':80' and ':443' wherever they stand in the authority, as older crawls did.
    """
    s, a = scheme(url), authority(url)
    if legacy_port:
        a = F.when(s == "http", F.replace(a, F.lit(":80"), F.lit(""))).otherwise(F.replace(a, F.lit(":443"), F.lit("")))
    else:
        a = F.when(s == "http", F.regexp_replace(a, r":80$", "")).otherwise(F.regexp_replace(a, r":443$", ""))
    p = path(url)
    p = F.when(p == "", F.lit("/")).when(p == "/", p).otherwise(F.regexp_replace(p, r"/+$", ""))
    q = _once(clean_query(query(url)), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    full = F.concat(s, F.lit("://"), a, p, q)
    return F.when(s.isin("http", "https"), full).otherwise(F.lit(""))


def fingerprint(url: Column) -> Column:
    return F.md5(url)


def should_skip(url: Column, max_length: int = 2048) -> Column:
    ending = "(" + "|".join(e.replace(".", r"\.") for e in SKIP_ENDINGS) + ")$"
    return ~scheme(url).isin("http", "https") | F.lower(path(url)).rlike(ending) | (F.length(url) > max_length)


def on_site(url: Column, wanted: str) -> Column:
    """Whether the host is `wanted` or below it; a blank `wanted` matches all."""
    wanted = wanted.strip().lower()
    if not wanted:
        return F.lit(True)
    h = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    return (h == wanted) | h.endswith("." + wanted)
