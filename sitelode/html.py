"""HTML pages as one wide record, with built-in functions only.

Tags are found with regular expressions after comments and the text of scripts, styles, noscripts and
SVGs are gone; nothing is decoded (entities stay as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import urls

NOISE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>"
HEAD = r"(?is)^.*?<body\b[^>]*>"
TAG = r"<[^>]*>"
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"
HREF = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"
REL = r"(?is)^<a\b[^>]*\brel\s*=\s*[\"']([^\"']*)[\"']"


def _first(html: Column, pattern: str) -> Column:
    """Group 1 of the first match, trimmed; null where missing or empty."""
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def meta(html: Column, key: str) -> Column:
    """content of ``<meta name=key>``, else of ``<meta property=key>``."""
    found = [_first(html, rf"(?is)<meta\b[^>]*\b{a}\s*=\s*[\"']{key}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']") for a in ("name", "property")]
    return F.coalesce(*found)


def texts(html: Column, tag: str) -> Column:
    """Trimmed texts of all ``tag`` elements, empty ones left out."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)
    return F.filter(F.transform(inner, lambda x: F.trim(F.regexp_replace(x, TAG, ""))), lambda x: x != "")


def _headings(html: Column, level: int) -> Column:
    return F.transform(texts(html, f"h{level}"), lambda t: F.struct(F.lit(level).alias("level"), t.alias("text")))


def count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with meta, headings, links, images, counts and text statistics.

    A page without html gives a record of nulls and zeros.
    """
    raw = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", raw.alias("raw"), F.regexp_replace(raw, NOISE, " ").alias("clean"))
    c = F.col("clean")
    rows = rows.select(
        "page_id",
        "url",
        "raw",
        "clean",
        urls.host(F.col("url")).alias("host"),
        F.coalesce(_first(c, r"(?is)<title\b[^>]*>(.*?)</title\s*>"), meta(c, "og:title"), meta(c, "twitter:title")).alias("title"),
        F.coalesce(meta(c, "description"), meta(c, "og:description"), meta(c, "twitter:description")).alias("description"),
        _first(c, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']").alias("canonical"),
        meta(c, "robots").alias("robots"),
        _first(c, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']([^\"']*)[\"']").alias("lang"),
        _first(c, r"(?is)<meta\b[^>]*\bcharset\s*=\s*[\"']?([^\"'>\s]+)").alias("charset"),
        meta(c, "viewport").alias("viewport"),
        meta(c, "og:title").alias("og_title"),
        meta(c, "og:image").alias("og_image"),
        meta(c, "og:description").alias("og_description"),
        meta(c, "og:type").alias("og_type"),
        meta(c, "og:url").alias("og_url"),
        meta(c, "twitter:card").alias("twitter_card"),
        F.flatten(F.array(*[_headings(c, n) for n in range(1, 7)])).alias("headings"),
        F.transform(
            F.filter(F.regexp_extract_all(c, F.lit(ANCHOR), 0), lambda a: ~a.contains("/cdn-cgi/l/email-protection")),
            lambda a: F.struct(
                urls.join(F.col("url"), F.trim(F.regexp_extract(a, HREF, 1))).alias("href"),
                F.trim(F.regexp_replace(a, TAG, "")).alias("text"),
                F.lower(F.regexp_extract(a, REL, 1)).alias("rel"),
            ),
        ).alias("anchors"),
        F.regexp_extract_all(c, F.lit(r"(?is)<img\b[^>]*>"), 0).alias("images"),
        F.regexp_extract_all(raw_scripts(), F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1).alias("json_ld"),
        F.regexp_replace(F.regexp_replace(c, HEAD, " "), TAG, " ").alias("body"),
    )
    return rows.select(
        "*",
        F.transform("anchors", lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text"), a["rel"].alias("rel"), (urls.host(a["href"]) != F.col("host")).alias("is_external"))).alias("links"),
        F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")).cast("long").alias("word_count"),
        count(F.col("body"), r"[.!?]+").cast("long").alias("sentence_count"),
    ).drop("anchors")


def raw_scripts() -> Column:
    """Scripts are cut from ``clean``, so JSON-LD is read from the page without its comments."""
    return F.regexp_replace("raw", r"(?is)<!--.*?-->", " ")


def facts(parsed: DataFrame) -> DataFrame:
    """The flat record that rules are evaluated on."""
    c, h = F.col("clean"), F.col("headings")
    levels = F.transform(h, lambda x: x["level"])
    jumps = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: b > a + 1)
    landmark = lambda tag, role: c.rlike(rf"(?is)<{tag}\b|\brole\s*=\s*[\"']{role}[\"']")
    size = lambda x: F.size(x).cast("long")
    return parsed.select(
        "page_id",
        "url",
        "host",
        urls.path(F.col("url")).alias("path"),
        F.octet_length("url").cast("long").alias("url_bytes"),
        urls.depth(F.col("url")).cast("long").alias("url_depth"),
        urls.query_string(F.col("url")).alias("query"),
        "title",
        F.octet_length("title").cast("long").alias("title_bytes"),
        "description",
        F.octet_length("description").cast("long").alias("description_bytes"),
        "canonical",
        "robots",
        "lang",
        "charset",
        "viewport",
        "og_title",
        "og_image",
        "og_description",
        "og_type",
        "og_url",
        "twitter_card",
        size(F.filter(h, lambda x: x["level"] == 1)).alias("h1_count"),
        size(F.filter(h, lambda x: x["level"] == 2)).alias("h2_count"),
        size(h).alias("heading_count"),
        F.array_join(F.transform(h, lambda x: x["text"]), " ").alias("heading_text"),
        F.coalesce(F.exists(jumps, lambda x: x), F.lit(False)).alias("skips_level"),
        size("links").alias("link_count"),
        size(F.filter("links", lambda x: x["is_external"])).alias("external_links"),
        size(F.filter("links", lambda x: ~x["is_external"])).alias("internal_links"),
        size(F.filter("links", lambda x: x["rel"].rlike(r"\bnofollow\b"))).alias("nofollow_links"),
        size(F.filter("links", lambda x: x["text"] == "")).alias("empty_links"),
        size(F.filter("links", lambda x: F.lower(x["text"]).isin("click here", "here", "read more", "more", "learn more", "link"))).alias("generic_links"),
        size(F.filter("links", lambda x: x["href"].startswith("http://"))).alias("insecure_links"),
        size("images").alias("image_count"),
        size(F.filter("images", lambda x: ~x.rlike(r"(?is)\balt\s*="))).alias("images_missing_alt"),
        size(F.filter("images", lambda x: x.rlike(r"(?is)\balt\s*=\s*[\"'][\"']"))).alias("images_empty_alt"),
        size(F.filter("images", lambda x: ~x.rlike(r"(?is)\bwidth\s*=") | ~x.rlike(r"(?is)\bheight\s*="))).alias("images_without_size"),
        size(F.filter("images", lambda x: x.rlike(r"(?is)\bloading\s*=\s*[\"']lazy[\"']"))).alias("images_lazy"),
        size("json_ld").alias("json_ld_count"),
        landmark("main", "main").alias("has_main"),
        landmark("nav", "navigation").alias("has_nav"),
        landmark("header", "banner").alias("has_header"),
        landmark("footer", "contentinfo").alias("has_footer"),
        c.rlike(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']#[^\"']*[\"'][^>]*>[^<]*skip").alias("has_skip_link"),
        c.rlike(r"(?is)^\s*<!doctype\s+html").alias("has_doctype"),
        c.rlike(r"(?is)<link\b[^>]*\brel\s*=\s*[\"'][^\"']*icon").alias("has_icon"),
        count(c, r"(?is)<table\b").cast("long").alias("table_count"),
        count(c, r"(?is)<th\b").cast("long").alias("th_count"),
        count(c, r"(?is)<form\b").cast("long").alias("form_count"),
        count(c, r"(?is)<input\b").cast("long").alias("input_count"),
        count(c, r"(?is)<label\b").cast("long").alias("label_count"),
        count(c, r"(?is)<iframe\b").cast("long").alias("iframe_count"),
        count(c, r"(?is)<(ul|ol)\b").cast("long").alias("list_count"),
        count(c, r"(?is)<p\b").cast("long").alias("paragraph_count"),
        count(c, r"(?is)\bstyle\s*=\s*[\"']").cast("long").alias("inline_styles"),
        count(c, r"(?is)\bhreflang\s*=").cast("long").alias("hreflang_count"),
        count(c, r"(?is)\bon(click|load|error|submit|change|mouseover)\s*=").cast("long").alias("inline_handlers"),
        count(c, r"(?is)\btabindex\s*=\s*[\"']?[1-9]").cast("long").alias("positive_tabindex"),
        count(c, r"(?is)\baria-[a-z]+\s*=").cast("long").alias("aria_count"),
        count(F.col("raw"), r"(?is)<script\b").cast("long").alias("script_count"),
        count(F.col("raw"), r"(?is)<script\b[^>]*\bsrc\s*=").cast("long").alias("external_scripts"),
        count(F.col("raw"), r"(?is)<style\b").cast("long").alias("style_count"),
        "word_count",
        "sentence_count",
        F.octet_length("raw").cast("long").alias("html_bytes"),
        F.octet_length("body").cast("long").alias("body_bytes"),
    )


def page_facts(pages: DataFrame) -> DataFrame:
    return facts(parse(pages))


def _duck_meta(key: str) -> str:
    one = "nullif(trim(regexp_extract(clean, '(?is)<meta\\b[^>]*\\b{a}\\s*=\\s*[\"'']" + key + "[\"''][^>]*\\bcontent\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)), '')"
    return f"coalesce({one.format(a='name')}, {one.format(a='property')})"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _duck_count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_lit(pattern)}))"


def _duck_first(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(clean, {_lit(pattern)}, 1)), '')"


def _duck_texts(n: int) -> str:
    tag = f"h{n}"
    inner = f"regexp_extract_all(clean, {_lit(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>')}, 1)"
    return f"list_transform(list_filter(list_transform({inner}, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> ''), lambda x: {{'level': {n}, 'text': x}})"


_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def _duck_join(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, {_lit(_ORIGIN)}, 0)"
    plain = f"regexp_replace({base}, '[?#].*$', '')"
    folder = f"CASE WHEN regexp_extract({base}, {_lit(urls.PATH)}, 1) = '' THEN {origin} || '/' ELSE regexp_replace({plain}, '[^/]*$', '') END"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {href}
      WHEN starts_with({href}, '//') THEN lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || ':' || {href}
      WHEN starts_with({href}, '/') THEN {origin} || {href}
      WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href}
      WHEN starts_with({href}, '?') THEN {plain} || {href}
      WHEN {href} = '' THEN regexp_replace({base}, '#.*$', '')
      ELSE {folder} || {href} END"""


def _landmark(tag: str, role: str) -> str:
    return "regexp_matches(clean, " + _lit(rf"(?is)<{tag}\b|\brole\s*=\s*[\"']{role}[\"']") + ")"


def _host(e: str) -> str:
    return f"lower(regexp_extract({e}, {_lit(urls.HOST)}, 1))"


def _pathsql(e: str) -> str:
    p = f"regexp_extract({e}, {_lit(urls.PATH)}, 1)"
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


#: DuckDB: common table expressions pg (parsed pages) and pf (page facts), without WITH.
SQL = f"""
pg0 AS (SELECT page_id, url, coalesce(html, '') AS raw, regexp_replace(coalesce(html, ''), {_lit(NOISE)}, ' ', 'g') AS clean FROM pages),
pg AS (
  SELECT page_id, url, raw, clean, {_host('url')} AS host,
    coalesce({_duck_first(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, {_duck_meta('og:title')}, {_duck_meta('twitter:title')}) AS title,
    coalesce({_duck_meta('description')}, {_duck_meta('og:description')}, {_duck_meta('twitter:description')}) AS description,
    {_duck_first(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']")} AS canonical,
    {_duck_meta('robots')} AS robots,
    {_duck_first(r"(?is)<html\b[^>]*\blang\s*=\s*[\"']([^\"']*)[\"']")} AS lang,
    {_duck_first(r"(?is)<meta\b[^>]*\bcharset\s*=\s*[\"']?([^\"'>\s]+)")} AS charset,
    {_duck_meta('viewport')} AS viewport, {_duck_meta('og:title')} AS og_title, {_duck_meta('og:image')} AS og_image,
    {_duck_meta('og:description')} AS og_description, {_duck_meta('og:type')} AS og_type, {_duck_meta('og:url')} AS og_url, {_duck_meta('twitter:card')} AS twitter_card,
    flatten([{', '.join(_duck_texts(n) for n in range(1, 7))}]) AS headings,
    list_transform(list_filter(regexp_extract_all(clean, {_lit(ANCHOR)}), lambda a: NOT contains(a, '/cdn-cgi/l/email-protection')),
      lambda a: {{'href': {_duck_join('url', f"trim(regexp_extract(a, {_lit(HREF)}, 1))")}, 'text': trim(regexp_replace(a, '<[^>]*>', '', 'g')), 'rel': lower(regexp_extract(a, {_lit(REL)}, 1))}}) AS links,
    regexp_extract_all(clean, '(?is)<img\\b[^>]*>') AS images,
    regexp_extract_all(regexp_replace(raw, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*application/ld\\+json[^>]*>(.*?)</script\\s*>', 1) AS json_ld,
    regexp_replace(regexp_replace(clean, {_lit(HEAD)}, ' '), '<[^>]*>', ' ', 'g') AS body
  FROM pg0
),
pf AS (
  SELECT page_id, url, host, {_pathsql('url')} AS path, strlen(url) AS url_bytes,
    len(list_filter(string_split({_pathsql('url')}, '/'), lambda s: s <> '')) AS url_depth,
    regexp_extract(url, '\\?([^#]*)', 1) AS query,
    title, strlen(title) AS title_bytes, description, strlen(description) AS description_bytes, canonical, robots, lang, charset, viewport,
    og_title, og_image, og_description, og_type, og_url, twitter_card,
    len(list_filter(headings, lambda x: x.level = 1)) AS h1_count, len(list_filter(headings, lambda x: x.level = 2)) AS h2_count, len(headings) AS heading_count,
    array_to_string(list_transform(headings, lambda x: x.text), ' ') AS heading_text,
    len(list_filter(range(1, len(headings)), lambda i: headings[i + 1].level > headings[i].level + 1)) > 0 AS skips_level,
    len(links) AS link_count,
    len(list_filter(links, lambda x: {_host('x.href')} <> host)) AS external_links, len(list_filter(links, lambda x: {_host('x.href')} = host)) AS internal_links,
    len(list_filter(links, lambda x: regexp_matches(x.rel, '\\bnofollow\\b'))) AS nofollow_links,
    len(list_filter(links, lambda x: x.text = '')) AS empty_links,
    len(list_filter(links, lambda x: lower(x.text) IN ('click here', 'here', 'read more', 'more', 'learn more', 'link'))) AS generic_links,
    len(list_filter(links, lambda x: starts_with(x.href, 'http://'))) AS insecure_links,
    len(images) AS image_count,
    len(list_filter(images, lambda x: NOT regexp_matches(x, '(?is)\\balt\\s*='))) AS images_missing_alt,
    len(list_filter(images, lambda x: regexp_matches(x, {_lit(r'''(?is)\balt\s*=\s*["']["']''')}))) AS images_empty_alt,
    len(list_filter(images, lambda x: NOT regexp_matches(x, '(?is)\\bwidth\\s*=') OR NOT regexp_matches(x, '(?is)\\bheight\\s*='))) AS images_without_size,
    len(list_filter(images, lambda x: regexp_matches(x, {_lit(r'''(?is)\bloading\s*=\s*["']lazy["']''')}))) AS images_lazy,
    len(json_ld) AS json_ld_count,
    {_landmark('main', 'main')} AS has_main, {_landmark('nav', 'navigation')} AS has_nav, {_landmark('header', 'banner')} AS has_header, {_landmark('footer', 'contentinfo')} AS has_footer,
    regexp_matches(clean, {_lit(r'''(?is)<a\b[^>]*\bhref\s*=\s*["']#[^"']*["'][^>]*>[^<]*skip''')}) AS has_skip_link,
    regexp_matches(clean, '(?is)^\\s*<!doctype\\s+html') AS has_doctype,
    regexp_matches(clean, {_lit(r'''(?is)<link\b[^>]*\brel\s*=\s*["'][^"']*icon''')}) AS has_icon,
    {_duck_count('clean', r'(?is)<table\b')} AS table_count, {_duck_count('clean', r'(?is)<th\b')} AS th_count, {_duck_count('clean', r'(?is)<form\b')} AS form_count,
    {_duck_count('clean', r'(?is)<input\b')} AS input_count, {_duck_count('clean', r'(?is)<label\b')} AS label_count, {_duck_count('clean', r'(?is)<iframe\b')} AS iframe_count,
    {_duck_count('clean', r'(?is)<(ul|ol)\b')} AS list_count, {_duck_count('clean', r'(?is)<p\b')} AS paragraph_count,
    {_duck_count('clean', r'''(?is)\bstyle\s*=\s*["']''')} AS inline_styles, {_duck_count('clean', r'(?is)\bhreflang\s*=')} AS hreflang_count,
    {_duck_count('clean', r'(?is)\bon(click|load|error|submit|change|mouseover)\s*=')} AS inline_handlers,
    {_duck_count('clean', r'''(?is)\btabindex\s*=\s*["']?[1-9]''')} AS positive_tabindex, {_duck_count('clean', r'(?is)\baria-[a-z]+\s*=')} AS aria_count,
    {_duck_count('raw', r'(?is)<script\b')} AS script_count, {_duck_count('raw', r'(?is)<script\b[^>]*\bsrc\s*=')} AS external_scripts, {_duck_count('raw', r'(?is)<style\b')} AS style_count,
    len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS word_count, {_duck_count('body', '[.!?]+')} AS sentence_count,
    strlen(raw) AS html_bytes, strlen(body) AS body_bytes
  FROM pg
),
links AS (
  SELECT page_id, url AS source_url, u.href AS target_url, u.text AS anchor_text, u.rel AS rel, {_host('u.href')} <> host AS is_external
  FROM (SELECT page_id, url, host, unnest(links) AS u FROM pg)
)
"""
