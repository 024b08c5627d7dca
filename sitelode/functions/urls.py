"""URL columns. Callers need different identities of a URL, so the helpers stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    """Path of an absolute URL; the root has ``/``."""
    p = F.regexp_extract(url, PATH, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    """The identity of link-graph vertices."""
    return F.regexp_replace(url, "#.*$", "")


def without_slash(url: Column) -> Column:
    """The identity that site rules use: one slash at the end goes."""
    return F.regexp_replace(url, "/$", "")


def normal_path(url: Column) -> Column:
    p = path(url)
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def port(url: Column) -> Column:
    """The written port, or the scheme's own."""
    written = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#:]+:([0-9]+)", 1)
    plain = F.when(scheme(url) == "https", F.lit("443")).when(scheme(url) == "http", F.lit("80")).otherwise(F.lit(""))
    return F.when(written == "", plain).otherwise(written)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def identity(url: Column) -> Column:
    """Equal for URLs of one scheme, host, port, path (but for a last slash) and query."""
    return F.concat_ws("|", scheme(url), host(url), port(url), normal_path(url), query_string(url))


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def join(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``, for the forms that pages use; dot segments stay."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.regexp_extract(base, PATH, 1) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(plain, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(folder, href))
    )


def domain_hash(url: Column) -> Column:
    """FNV-1a (32 bits) of the host, for dealing hosts to workers."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(host(url))), lambda i: F.conv(F.hex(F.substring(F.encode(host(url), "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    return F.when(host(url) == "", F.lit(2166136261)).otherwise(F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)) % F.lit(4294967296)))
