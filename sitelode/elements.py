"""Images, forms, tables, scripts, styles and meta links of pages: records, and counts that rules read.

Expressions are built once, by an object that spells them for Spark or for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html
from .registry import query, texts


class Dialect:
    """SQL for the few list and pattern functions that element facts need. ``src`` is a column, ``x`` a lambda's variable."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        return "'" + (value.replace("\\", "\\\\").replace("'", "\\'") if self.spark else value.replace("'", "''")) + "'"

    def all(self, src: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({src}, {self.text('(?is)' + pattern)}, {group})"

    def first(self, src: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({src}, {self.text('(?is)' + pattern)}, {group})"

    def has(self, src: str, pattern: str) -> str:
        return f"{src} RLIKE {self.text('(?is)' + pattern)}" if self.spark else f"regexp_matches({src}, {self.text('(?is)' + pattern)})"

    def each(self, kind: str, items: str, f: Callable[[str], str]) -> str:
        arrow = "x -> " if self.spark else "lambda x: "
        return f"{kind if self.spark else 'list_' + kind}({items}, {arrow}{f('x')})"

    def keep(self, items: str, f: Callable[[str], str]) -> str:
        return self.each("filter", items, f)

    def map(self, items: str, f: Callable[[str], str]) -> str:
        return self.each("transform", items, f)

    def size(self, items: str) -> str:
        return f"CAST(size({items}) AS BIGINT)" if self.spark else f"len({items})"

    def distinct(self, items: str) -> str:
        return f"array_distinct({items})" if self.spark else f"list_distinct({items})"

    def holds(self, items: str, value: str) -> str:
        return f"array_contains({items}, {value})" if self.spark else f"list_contains({items}, {value})"

    def joined(self, items: str) -> str:
        return f"array_join({items}, ' ')" if self.spark else f"array_to_string({items}, ' ')"


def attr(name: str) -> str:
    return rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']"


_INPUT = r"<(?:input|select|textarea)\b[^>]*>"
_QUIET = r"\btype\s*=\s*[\"'](hidden|submit|button|image|reset)[\"']"


def tags(d: Dialect) -> dict[str, str]:
    """Lists of tags that several columns of ``facts`` read, over ``c`` and ``s``, and the texts of forms and labels as one."""
    forms = d.joined(d.all("c", r"<form\b.*?</form\s*>"))
    return {
        "image_tags": d.all("c", r"<img\b[^>]*>"),
        "table_texts": d.all("c", r"<table\b.*?</table\s*>"),
        "form_texts": d.all("c", r"<form\b.*?</form\s*>"),
        "input_tags": d.all(forms, _INPUT),
        "script_tags": d.all("s", r"<script\b[^>]*>"),
        "sheet_tags": d.all("c", r"<link\b[^>]*\brel\s*=\s*[\"']stylesheet[\"'][^>]*>"),
        "lang_tags": d.all("c", r"<link\b[^>]*\bhreflang\s*=\s*[\"'][^\"']*[\"'][^>]*>"),
    }


def facts(d: Dialect, found: dict[str, str] | None = None) -> dict[str, str]:
    """Columns over ``c`` (the page without comments and scripts), ``s`` (with scripts), ``url``, ``title``, ``description``, ``canonical`` and ``found``: what stands for each of ``tags``."""
    found = found or tags(d)
    images, tables, forms, inputs, scripts, sheets = (found[k] for k in ("image_tags", "table_texts", "form_texts", "input_tags", "script_tags", "sheet_tags"))
    targets = d.map(d.all(d.joined(forms), r"<label\b[^>]*>"), lambda x: d.first(x, attr("for")))
    wrapped = d.all(d.joined(d.all(d.joined(forms), r"<label\b.*?</label\s*>")), _INPUT)
    named = lambda x: f"({d.has(x, r'\baria-label(ledby)?\s*=')} OR ({d.first(x, attr('id'))} <> '' AND {d.holds('label_targets', d.first(x, attr('id')))}) OR {d.holds('wrapped_inputs', x)})"
    external = lambda x: f"({d.has(x, attr('src'))})"
    langs = d.map(found["lang_tags"], lambda x: d.first(x, attr("hreflang")))
    hrefs = d.map(found["lang_tags"], lambda x: d.first(x, attr("href")))
    meta = lambda key: d.first(d.first("c", rf"<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{key}[\"'][^>]*>", 0), attr("content"))
    n = lambda items, f=None: d.size(d.keep(items, f) if f else items)
    generic = r"^(image|photo|picture|img|icon|logo|graphic|untitled)$"
    return {
        "label_targets": targets,
        "wrapped_inputs": wrapped,
        "images": n(images),
        "images_no_alt": n(images, lambda x: f"NOT {d.has(x, r'\balt\s*=')}"),
        "images_empty_alt": n(images, lambda x: d.has(x, r"\balt\s*=\s*[\"']\s*[\"']")),
        "images_empty_shown": n(images, lambda x: f"{d.has(x, r'\balt\s*=\s*[\"\']\s*[\"\']')} AND NOT {d.has(x, r'aria-hidden\s*=\s*[\"\']true')}"),
        "images_long_alt": n(images, lambda x: f"length({d.first(x, attr('alt'))}) > 125"),
        "images_generic_alt": n(images, lambda x: d.has(f"lower(trim({d.first(x, attr('alt'))}))", generic)),
        "images_lazy": n(images, lambda x: d.has(x, r"\bloading\s*=\s*[\"']lazy")),
        "images_no_size": n(images, lambda x: f"NOT {d.has(x, r'\bwidth\s*=')} OR NOT {d.has(x, r'\bheight\s*=')}"),
        "images_inline": n(images, lambda x: d.has(x, r"\bsrc\s*=\s*[\"']data:")),
        "images_modern": n(images, lambda x: d.has(x, r"\.(webp|avif)\b")),
        "tables": n(tables),
        "tables_headed": n(tables, lambda x: d.has(x, r"<th\b")),
        "tables_captioned": n(tables, lambda x: d.has(x, r"<caption\b")),
        "forms": n(forms),
        "forms_no_action": n(forms, lambda x: f"NOT {d.has(x, r'^<form\b[^>]*\baction\s*=')}"),
        "forms_many_bare": n(forms, lambda x: f"{d.size(d.all(x, _INPUT))} > 3 AND NOT {d.has(x, '<fieldset')}"),
        "inputs_unlabeled": n(inputs, lambda x: f"NOT {d.has(x, r'\btype\s*=\s*[\"\']hidden')} AND NOT {named(x)}"),
        "inputs_bare": n(inputs, lambda x: f"NOT {d.has(x, _QUIET)} AND NOT {named(x)}"),
        "inputs_required_bare": n(inputs, lambda x: f"{d.has(x, r'\brequired\b|aria-required\s*=\s*[\"\']true')} AND NOT {named(x)}"),
        "inputs_ids": n(inputs, lambda x: d.has(x, attr("id"))),
        "inputs_distinct_ids": d.size(d.distinct(d.keep(d.map(inputs, lambda x: d.first(x, attr("id"))), lambda x: f"{x} <> ''"))),
        "aria_labels": d.size(d.all("c", r"\baria-label\s*=")),
        "scripts_blocking": n(scripts, lambda x: f"{external(x)} AND NOT {d.has(x, r'\b(async|defer)\b|type\s*=\s*[\"\']module')}"),
        "scripts_external": n(scripts, lambda x: d.has(x, r"\bsrc\s*=\s*[\"'](https?:)?//")),
        "scripts_unsigned": n(scripts, lambda x: f"{d.has(x, r'\bsrc\s*=\s*[\"\'](https?:)?//')} AND NOT {d.has(x, r'\bintegrity\s*=')}"),
        "sheets_unsigned": n(sheets, lambda x: f"{d.has(x, r'\bhref\s*=\s*[\"\'](https?:)?//')} AND NOT {d.has(x, r'\bintegrity\s*=')}"),
        "langs": d.size(langs),
        "langs_distinct": d.size(d.distinct(d.map(langs, lambda x: f"lower({x})"))),
        "langs_default": n(langs, lambda x: f"lower({x}) = 'x-default'"),
        "langs_bad": n(langs, lambda x: f"NOT {d.has(x, r'^(x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*)$')}"),
        "langs_self": n(hrefs, lambda x: f"{x} = url"),
        "canonicals": d.size(d.all("c", r"<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>")),
        "og_video": meta("og:video"),
        "og_site": meta("og:site_name"),
        "og_width": meta("og:image:width"),
        "twitter_site": meta("twitter:site"),
    }


#: Markup that is added to pages by their number: divisor, remainders, for the head or the body, and what.
ADDED = [
    (3, (0, 1), "head", '<meta name="description" content="What a page says of itself in a line or two, page by page and word by word for everyone who reads on.">'),
    (4, (0, 1), "head", '<link rel="canonical" href="https://example.com/one#part">'),
    (8, (1,), "head", '<link rel="canonical" href="https://example.com/two?x=1">'),
    (3, (1,), "head", '<link rel="alternate" hreflang="en" href="https://example.com/en"><link rel="alternate" hreflang="de-AT" href="https://example.com/de">'),
    (6, (1, 2), "head", '<link rel="alternate" hreflang="en" href="https://example.com/e2"><link rel="alternate" hreflang="x-default" href="https://example.com/">'),
    (7, (3,), "head", '<link rel="alternate" hreflang="english" href="https://example.com/e3">'),
    (5, (0, 1, 2), "head", '<meta property="og:video" content="https://v.example/1"><meta property="og:image:width" content="400"><meta property="og:locale:alternate" content="de">'),
    (5, (3,), "head", '<meta property="og:site_name" content="A site"><meta name="twitter:site" content="asite">'),
    (4, (2, 3), "head", '<script src="https://cdn.example/a.js"></script><script async src="/b.js"></script><link rel="stylesheet" href="//cdn.example/a.css">'),
    (6, (5,), "head", '<script src="https://cdn.example/c.js" integrity="sha256-x" defer></script>'),
    (2, (0,), "body", '<img src="a.webp" alt="A river" width="3" height="4" loading="lazy"><img src="data:image/png;base64,x"><img src="/photo.jpg" alt="photo">'),
    (3, (2,), "body", '<img src="b.png" alt=""><img src="c.png" alt="" aria-hidden="true"><img src="d.png" width="1"><img src="e.png" alt="image">'),
    (4, (1,), "body", "<table><tr><td>1</td></tr></table><table><caption>C</caption><tr><th>h</th></tr></table>"),
    (5, (4,), "body", "<table><tr><td>2</td></tr></table>"),
    (3, (0,), "body", '<form action="/go"><label for="q">Query</label><input id="q" name="q" required><input type="hidden" name="t"><input id="q" type="text"><label>Name <input name="n"></label></form>'),
    (4, (3,), "body", '<form><input name="a"><input name="b" required aria-label="B"><select name="c"></select><textarea name="d"></textarea><input type="submit"></form>'),
    (7, (2,), "body", '<form action="x"><fieldset><input name="r" required></fieldset></form>'),
    (9, (4,), "body", '<script type="application/ld+json">{"@type": "Article", "headline": "H"}</script>'),
]


def enriched(pages: DataFrame) -> DataFrame:
    """``pages`` with ``ADDED``: the given pages have no images, forms, tables or links in the head, so that rules would have nothing to see."""
    def put(where: str):
        parts = [F.when((F.col("page_id") % n).isin(*there), F.lit(x)).otherwise(F.lit("")) for n, there, at, x in ADDED if at == where]
        return F.concat(*parts)

    page = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.replace(F.replace(page, F.lit("</head>"), F.concat(put("head"), F.lit("</head>"))), F.lit("</body>"), F.concat(put("body"), F.lit("</body>"))).alias("html"))


def element_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, title, description, canonical and the columns of ``facts``."""
    parsed = html.parse(pages).select("page_id", "url", "title", "description", "canonical", F.col("clean").alias("c"), F.regexp_replace("raw", r"(?is)<!--.*?-->", " ").alias("s"))
    # each list is found once: Spark shares nothing between the functions with lambdas that read it
    lists = tags(Dialect(True))
    made = facts(Dialect(True), {n: n for n in lists})
    first = ("label_targets", "wrapped_inputs")
    rows = parsed.select("*", *[F.expr(e).alias(n) for n, e in lists.items()])
    rows = rows.select("*", *[F.expr(made[n]).alias(n) for n in first])
    return rows.select("page_id", "url", "title", "description", "canonical", *[F.expr(e).alias(n) for n, e in made.items() if n not in first])


def _added(where: str) -> str:
    parts = [f"CASE WHEN page_id % {n} IN ({', '.join(map(str, there))}) THEN {Dialect(False).text(x)} ELSE '' END" for n, there, at, x in ADDED if at == where]
    return " || ".join(parts)


_made = facts(Dialect(False))
#: DuckDB: common table expressions up to ef (element facts) over enriched pages, without WITH.
SQL = (
    html.SQL.replace("FROM pages)", f"FROM (SELECT page_id, url, replace(replace(coalesce(html, ''), '</head>', {_added('head')} || '</head>'), '</body>', {_added('body')} || '</body>') AS html FROM pages) AS added)", 1)
    + f""", ec AS (SELECT pg.page_id, pg.url, pg.title, pg.description, pg.canonical, clean AS c, regexp_replace(raw, '(?is)<!--.*?-->', ' ', 'g') AS s FROM pg),
el AS (SELECT *, {_made['label_targets']} AS label_targets, {_made['wrapped_inputs']} AS wrapped_inputs FROM ec),
ef AS (SELECT page_id, url, title, description, canonical, {', '.join(f'{e} AS {n}' for n, e in _made.items() if n not in ('label_targets', 'wrapped_inputs'))} FROM el)"""
)


@query("element_facts", f"WITH {SQL} SELECT * FROM ef")
def element_facts_query(spark, sf_dir):
    """Counts of elements of every page, with what ``enriched`` adds."""
    return element_facts(enriched(texts(spark, sf_dir, "pages")))


@query("og_properties", f"WITH {SQL}, m AS (SELECT page_id, unnest({Dialect(False).all('c', r'<meta\b[^>]*\bproperty\s*=\s*[\"\']og:[^\"\']*[\"\'][^>]*>')}) AS x FROM ec) SELECT page_id, regexp_extract(x, '(?is){attr('property').replace(chr(39), chr(39) * 2)}', 1)[4:] AS name, regexp_extract(x, '(?is){attr('content').replace(chr(39), chr(39) * 2)}', 1) AS content FROM m")
def og_properties(spark, sf_dir):
    """Open Graph properties of pages, by name without ``og:``."""
    rows = html.parse(enriched(texts(spark, sf_dir, "pages"))).select("page_id", F.explode(F.regexp_extract_all("clean", F.lit(r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']og:[^\"']*[\"'][^>]*>"), 0)).alias("x"))
    return rows.select("page_id", F.substring(F.regexp_extract("x", "(?is)" + attr("property"), 1), 4, 1000).alias("name"), F.regexp_extract("x", "(?is)" + attr("content"), 1).alias("content"))


@query("hreflang_reciprocity", f"WITH {SQL}, t AS (SELECT page_id, url, unnest({Dialect(False).all('c', r'<link\b[^>]*\bhreflang\s*=\s*[\"\'][^\"\']*[\"\'][^>]*>')}) AS x FROM ec), h AS (SELECT page_id, url, regexp_extract(x, '(?is){attr('hreflang').replace(chr(39), chr(39) * 2)}', 1) AS lang, regexp_extract(x, '(?is){attr('href').replace(chr(39), chr(39) * 2)}', 1) AS target FROM t) SELECT page_id, lang, target, EXISTS (SELECT 1 FROM h b WHERE b.url = h.target AND b.target = h.url) AS returned FROM h GROUP BY ALL")
def hreflang_reciprocity(spark, sf_dir):
    """Does the page that an alternate link names link back?"""
    tag = r"(?is)<link\b[^>]*\bhreflang\s*=\s*[\"'][^\"']*[\"'][^>]*>"
    t = html.parse(enriched(texts(spark, sf_dir, "pages"))).select("page_id", "url", F.explode(F.regexp_extract_all("clean", F.lit(tag), 0)).alias("x"))
    h = t.select("page_id", "url", F.regexp_extract("x", "(?is)" + attr("hreflang"), 1).alias("lang"), F.regexp_extract("x", "(?is)" + attr("href"), 1).alias("target")).distinct()
    back = h.select(F.col("target").alias("url"), F.col("url").alias("target"), F.lit(True).alias("returned")).distinct()
    return h.join(back, ["url", "target"], "left").select("page_id", "lang", "target", F.coalesce("returned", F.lit(False)).alias("returned")).distinct()
