"""Scalar columns: colours and contrast, page numbers, labels, retries, templates, with queries that show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import html
from ..registry import query, table, texts

# Query keys that hold a page number, in order.
PAGE_KEYS = "page p pg start offset pagina".split()


def hex_channels(color: Column) -> Column:
    """Red, green, blue (0 to 255) of ``#rgb`` or ``#rrggbb``."""
    h = F.regexp_extract(F.lower(color), "^#([0-9a-f]{6}|[0-9a-f]{3})$", 1)
    long = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(h != "", F.array(*[F.conv(F.substring(long, k, 2), 16, 10).cast("int") for k in (1, 3, 5)]))


def luminance(channels: Column) -> Column:
    lin = F.transform(channels, lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))))
    return lin[0] * 0.2126 + lin[1] * 0.7152 + lin[2] * 0.0722


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(hex_channels(a)), luminance(hex_channels(b))
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def page_number(url: Column) -> Column:
    """The page that a URL asks for: by query key, then by ``/page/n``."""
    found = [F.regexp_extract(url, rf"[?&]{k}=([0-9]+)", 1) for k in PAGE_KEYS] + [F.regexp_extract(url, r"/page/([0-9]+)", 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found]).try_cast("int")


def backoff(attempt: Column, base: int, now: Column, most: int = 900_000) -> Column:
    """Milliseconds to wait: doubling, at most 15 minutes, with a jitter of the clock."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long") + F.pmod(now, F.lit(base))


def retry_score(ms: Column, priority: Column) -> Column:
    return F.shiftleft(ms, 8).bitwiseOR(priority.bitwiseAND(F.lit(255)))


def breadcrumb(url: Column) -> Column:
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)
    parts = F.filter(F.split(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")
    return F.array_join(F.concat(F.array(host), parts), " › ")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render(template: str, **values: Column) -> Column:
    """``template`` with each {{name}} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


_LEVEL = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_CHANNEL = "CAST('0x' || substr({0}, {1}, 2) AS INTEGER)"


def _luminance_sql(h: str) -> str:
    return " + ".join(f"{w} * ({_LEVEL.format(_CHANNEL.format(h, k))})" for w, k in ((0.2126, 2), (0.7152, 4), (0.0722, 6)))


@query(
    "contrast",
    f"""WITH c AS (SELECT page_id, '#' || lpad(lower(to_hex(page_id * 7919 % 16777216)), 6, '0') AS a, CASE WHEN page_id % 2 = 0 THEN '#ffffff' ELSE '#112233' END AS b FROM pages),
    l AS (SELECT *, {_luminance_sql('a')} AS x, {_luminance_sql('b')} AS y FROM c)
    SELECT page_id, a, CASE WHEN page_id % 2 = 0 THEN '#FFF' ELSE '#123' END AS b, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS ratio FROM l""",
)
def contrast_query(spark, sf_dir):
    """The contrast of a colour made of every page's number with white or a dark blue, in short and long notation."""
    p = F.col("page_id")
    a = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(p * 7919 % 16777216)), 6, "0"))
    rows = table(spark, sf_dir, "pages").select("page_id", a.alias("a"), F.when(p % 2 == 0, "#FFF").otherwise("#123").alias("b"))
    return rows.withColumn("ratio", F.round(contrast(F.col("a"), F.col("b")), 6))


_keys = ", ".join(f"nullif(regexp_extract(url, '[?&]{k}=([0-9]+)', 1), '')" for k in PAGE_KEYS)


@query("page_numbers", f"SELECT page_id, CAST(coalesce({_keys}, nullif(regexp_extract(url, '/page/([0-9]+)', 1), '')) AS INTEGER) AS page FROM pages")
def page_numbers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_number(F.col("url")).alias("page"))


@query("breadcrumbs", "SELECT page_id, array_to_string(list_concat([regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)], list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')), ' › ') AS breadcrumb FROM pages")
def breadcrumbs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", breadcrumb(F.col("url")).alias("breadcrumb"))


@query("retry_queue", "SELECT event_id, CAST(least(1000 * pow(2.0, event_id % 12), 900000.0) AS BIGINT) + event_id % 1000 AS wait_ms, ((event_id << 8) | (user_id & 255)) AS score FROM events")
def retry_queue(spark, sf_dir):
    """How long every event would wait, and the score by which a queue takes it up again."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", backoff(F.col("event_id") % 12, 1000, F.col("event_id")).alias("wait_ms"), retry_score(F.col("event_id"), F.col("user_id")).alias("score"))


def share_preview(facts):
    """url, title, description, site, crumb and image that a shared page shows, escaped: canonical URL else its own, stand-ins for what is missing."""
    at = F.coalesce("canonical", "url")
    say = lambda c, missing: escape_html(F.coalesce(c, F.lit(missing)))
    return facts.select(
        "page_id",
        escape_html(at).alias("shown_url"),
        say("title", "Untitled page").alias("title"),
        say("description", "No meta description stored for this page.").alias("description"),
        F.regexp_extract(at, "^[A-Za-z]+://([^/?#:]+)", 1).alias("site"),
        escape_html(breadcrumb(at)).alias("crumb"),
        escape_html(F.col("og_image")).alias("image"),
    )


def _duck_escape(e: str) -> str:
    return f"replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


_at = "coalesce(canonical, url)"
_crumb = f"array_to_string(list_concat([regexp_extract({_at}, '^[a-z]+://([^/?#]+)', 1)], list_filter(string_split(regexp_extract({_at}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')), ' › ')"


@query(
    "share_previews",
    f"WITH {html.SQL} SELECT page_id, {_duck_escape(_at)} AS shown_url, {_duck_escape("coalesce(title, 'Untitled page')")} AS title, {_duck_escape("coalesce(description, 'No meta description stored for this page.')")} AS description, regexp_extract({_at}, '^[A-Za-z]+://([^/?#:]+)', 1) AS site, {_duck_escape(_crumb)} AS crumb, {_duck_escape('og_image')} AS image FROM pf",
)
def share_previews(spark, sf_dir):
    return share_preview(html.page_facts(texts(spark, sf_dir, "pages")))


def collapsed(text: Column) -> Column:
    """White space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


@query("collapse_whitespace", "SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def collapse_whitespace(spark, sf_dir):
    """Digests of texts with their white space collapsed."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapsed(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


def shortened(url: Column, most: int) -> Column:
    """A label of at most ``most`` characters, the last one an ellipsis if something is cut."""
    return F.when(F.length(url) > most, F.concat(F.substring(url, 1, most - 1), F.lit("…"))).otherwise(url)


@query("url_labels", "SELECT page_id, CASE WHEN length(url) > 24 THEN substr(url, 1, 23) || '…' ELSE url END AS label FROM pages")
def url_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", shortened(F.col("url"), 24).alias("label"))


def charset(content_type: Column) -> Column:
    """The charset of a content type, lower case without quotes; null without one."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(content_type, "(?i)charset\\s*=\\s*[\"']?([^;\"'\\s]+)", 1))), F.lit(""))


def is_html(content_type: Column) -> Column:
    """Is a response to be judged as a document? One without a content type is."""
    return F.coalesce(F.lower(content_type).rlike("html|xhtml"), F.lit(True))


_TYPES = ["text/html; charset=UTF-8", "text/css", "application/pdf", "text/html;charset='iso-8859-1'", "application/xhtml+xml"]


@query("content_types", "WITH t AS (SELECT page_id, ['text/html; charset=UTF-8', 'text/css', 'application/pdf', 'text/html;charset=' || chr(39) || 'iso-8859-1' || chr(39), 'application/xhtml+xml', NULL][page_id % 6 + 1] AS content_type FROM pages) SELECT page_id, nullif(lower(trim(regexp_extract(content_type, '(?i)charset\\s*=\\s*[\"'']?([^;\"''\\s]+)', 1))), '') AS charset, coalesce(regexp_matches(lower(content_type), 'html|xhtml'), true) AS is_html FROM t")
def content_types(spark, sf_dir):
    """Charset of each response and whether it is a document; content types are dealt to the pages by number, as the table has none."""
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES], F.lit(None).cast("string")), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", charset(kind).alias("charset"), is_html(kind).alias("is_html"))


def private_host(host: Column) -> Column:
    """Is a host an address that a crawler must not reach: loopback, private, link-local, carrier, multicast, or local by name?"""
    local = F.lower(host).rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)$")
    v4 = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(22[4-9]|2[3-5][0-9])\.") & host.rlike(r"^[0-9.]+$")
    v6 = F.lower(host).rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$")
    return local | v4 | v6


@query("private_hosts", "WITH h AS (SELECT event_id, ['10.0.', '172.16.', '172.32.', '8.8.', '100.64.', '192.168.', '169.254.', '203.0.'][event_id % 8 + 1] || user_id % 256 || '.' || event_id % 200 AS host FROM events) SELECT event_id, host, event_id % 8 NOT IN (2, 3, 7) AS private FROM h")
def private_hosts(spark, sf_dir):
    """Addresses made of the events' numbers, each judged."""
    first = F.element_at(F.array(*[F.lit(x) for x in ("10.0.", "172.16.", "172.32.", "8.8.", "100.64.", "192.168.", "169.254.", "203.0.")]), (F.col("event_id") % 8 + 1).cast("int"))
    host = F.concat(first, (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 200).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", host.alias("host")).withColumn("private", private_host(F.col("host")))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order of their UTF-8 bytes and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


@query("canonical_payloads", """SELECT event_id, '{"event":"' || event_type || '","props":{"a":[true,null,{"b":2,"c":1}],"k":' || (props ->> '$.k') || '},"user":' || user_id || '}' AS payload FROM events""")
def canonical_payloads(spark, sf_dir):
    """Events as canonical JSON, from objects whose keys are in another order."""
    text = F.concat(F.lit('{ "user" : '), F.col("user_id").cast("string"), F.lit(', "props": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [true, null, {"c": 1, "b": 2}]}, "event": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", canonical_json(text).alias("payload"))


def hmac_sha256(key: str, text: Column) -> Column:
    """HMAC-SHA256 of a text, lower-case hex, by its definition: two nested hashes over the padded key."""
    block = key.encode()
    if len(block) > 64:
        import hashlib

        block = hashlib.sha256(block).digest()
    block = block.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


_PAD = lambda x: "unhex('" + bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() + "')"


@query("signed_payloads", f"SELECT event_id, sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(coalesce(props, ''))))) AS signature FROM events")
def signed_payloads(spark, sf_dir):
    """A signature of each event's payload."""
    return table(spark, sf_dir, "events").select("event_id", hmac_sha256("secret", F.coalesce("props", F.lit(""))).alias("signature"))


def style_values(page: Column, name: str) -> Column:
    """All values of a property in style attributes and sheets of a page, in order."""
    return F.transform(F.regexp_extract_all(page, F.lit(rf"(?is)(?:^|[;{{\"'\s]){name}\s*:\s*([^;}}\"']+)"), 1), lambda x: F.lower(F.trim(x)))


@query("inline_styles", "SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)(?:^|[;{\"''\\s])color\\s*:\\s*([^;}\"'']+)', 1), lambda x: lower(trim(x))) AS colors, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)(?:^|[;{\"''\\s])font-size\\s*:\\s*([^;}\"'']+)', 1), lambda x: lower(trim(x))) AS sizes FROM pages")
def inline_styles(spark, sf_dir):
    page = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", style_values(page, "color").alias("colors"), style_values(page, "font-size").alias("sizes"))


def marked_types(page: Column, attribute: str) -> Column:
    """Values of ``itemtype`` (microdata) or ``typeof`` (RDFa), one for each word, in order."""
    found = F.regexp_extract_all(page, F.lit(rf"(?is)\b{attribute}\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.filter(F.flatten(F.transform(found, lambda x: F.split(x, r"\s+"))), lambda x: x != "")


@query(
    "marked_types",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN ['https://schema.org/Article', 'https://schema.org/Thing', 'https://schema.org/Person'] ELSE [] END AS microdata, CASE WHEN page_id % 2 = 1 THEN ['Product', 'Offer'] ELSE [] END AS rdfa FROM pages""",
)
def marked_types_query(spark, sf_dir):
    """Types that microdata and RDFa on every page name, with marks put in by the page's number, as the given pages have none."""
    p = F.col("page_id")
    marks = F.concat(F.when(p % 3 == 0, '<div itemscope itemtype="https://schema.org/Article https://schema.org/Thing"><b itemtype=\'https://schema.org/Person\'>x</b></div>').otherwise(""), F.when(p % 2 == 1, '<div typeof="Product"><i TYPEOF = "Offer">y</i></div>').otherwise(""))
    page = F.concat(F.coalesce("html", F.lit("")), marks)
    return texts(spark, sf_dir, "pages").select("page_id", marked_types(page, "itemtype").alias("microdata"), marked_types(page, "typeof").alias("rdfa"))
