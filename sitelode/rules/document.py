"""Rules on a page's tree: landmarks, roles, focus, links' names, mixed content, microdata and RDFa.

Facts are counts of what selectors select; conditions are plain SQL over them, and all compile to one projection in
the page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dom, html
from ..functions import urls
from ..registry import query, texts
from .elements import SEVERITY, _lines

#: Counts of selected nodes.
SELECTED = {
    "banners": "header, [role=banner]",
    "navs": "nav, [role=navigation]",
    "mains": "main, [role=main]",
    "infos": "footer, [role=contentinfo]",
    "asides": "aside, [role=complementary]",
    "ahead": "[tabindex]:not([tabindex^='-']):not([tabindex='0'])",
    "aside_focus": "[tabindex^='-']",
    "roles": "[role]",
    "labels": "[aria-label], [aria-labelledby]",
    "bars_open": "[role=progressbar]:not([aria-valuenow])",
    "sliders_open": "[role=slider]:not([aria-valuenow]), [role=slider]:not([aria-valuemin]), [role=slider]:not([aria-valuemax])",
    "combos_open": "[role=combobox]:not([aria-expanded])",
    "tabs_open": "[role=tab]:not([aria-selected])",
    "dialogs": "[role=dialog], [role=alertdialog], dialog",
    "modals": "[aria-modal]",
    "items": "[itemscope]",
    "props": "[itemprop]",
    "rdfa": "[vocab], [typeof], [property]:not(meta), [about]",
    "vocabs": "[vocab]",
    "typeofs": "[typeof]",
    "searches": "link[rel~=search]",
    "plain_scripts": "script[src^='http://' i]",
    "plain_images": "img[src^='http://' i]",
    "plain_sheets": "link[href^='http://' i]",
    "plain_frames": "iframe[src^='http://' i]",
    "plain_forms": "form[action^='http://' i]",
    "unlanguaged": "html:not([lang])",
    "blank_lang": "html[lang='']",
}
#: Link texts that say nothing.
GENERIC = ("click here", "here", "read more", "more", "learn more", "link")

# Codes, severities, categories, titles and bounds.
RULES = """
banners + navs + mains + infos + asides = 0 | w accessibility ARIALAND-V2006 No ARIA landmarks found | w accessibility ARIALAND-V2001 No ARIA landmarks found (deep) | w accessibility LANDMARK001 No ARIA landmarks found
banners = 0 | w accessibility ARIALAND-ROLE-BANNER Missing banner landmark | i accessibility LANDBANNER-V5001 Missing banner landmark | i accessibility LANDBAN-V2001 Missing banner landmark (deep)
navs = 0 | w accessibility ARIALAND-ROLE-NAVIGATION Missing navigation landmark | i accessibility LANDNAV-V5001 Missing navigation landmark | i accessibility LANDNAV-V2001 Missing navigation landmark (deep) | i accessibility ARIALAND-V2003 Missing navigation landmark (deep)
mains = 0 | w accessibility ARIALAND-ROLE-MAIN Missing main landmark | w accessibility LANDMAIN-V5001 Missing main landmark | w accessibility LANDMAIN-V2001 Missing main landmark (deep) | w accessibility ARIALAND-V2002 Missing main landmark (deep)
infos = 0 | w accessibility ARIALAND-ROLE-CONTENTINFO Missing contentinfo landmark | w accessibility LANDCINFO-V6124 Missing contentinfo landmark | w accessibility LANDCINFO-V2001 Missing contentinfo landmark (deep)
asides = 0 | i accessibility LANDCOMP-V6125 No complementary landmark | i accessibility LANDCOMP-V2001 No complementary landmark (deep)
mains > 1 | w accessibility ARIALAND-V2005 Duplicate main landmarks | w accessibility LANDMAIN-V5002 Multiple main landmarks
ahead > 0 | w accessibility TAB-V2001 Positive tabindex values found | e accessibility TABINDEX001 Positive tabindex values detected | w accessibility FOCUS-V2001 Positive tabindex found | w accessibility FOCUSTABPOS-V6119 Positive tabindex detected | w accessibility FOCUS-V2001-DEEP-DEEP Positive tabindex found (deep-deep) | w accessibility FOCUS-V2001-DEEP-DEEP-DEEP Positive tabindex found (deep-deep-deep)
aside_focus > 3 | i accessibility FOCUSDEEP002 Many elements with tabindex=-1
roles > 0 AND labels = 0 | w accessibility ARIA-V2001 ARIA roles without names | w accessibility ARIA001 ARIA roles without accessible names | w accessibility ARIAREQ001 ARIA roles missing required accessible name attributes | w accessibility ARIALABEL001 ARIA roles without labels | w accessibility ARIAROLE001 ARIA roles without accessible names | i accessibility ARIAREQ-V2001 ARIA roles without labels (deep)
labels > 0 AND roles > labels | i accessibility ARIA002 ARIA roles may need accessible names on non-semantic elements
bars_open > 0 | w accessibility ARIAREQ-V2002 progressbar missing aria-valuenow
sliders_open > 0 | w accessibility ARIAREQ-V2003 slider missing required attributes
combos_open > 0 | w accessibility ARIAREQ-V2004 combobox missing aria-expanded
tabs_open > 0 | i accessibility ARIAREQ-V2005 tab missing aria-selected
dialogs > 0 AND modals = 0 | w accessibility FOCTR001 Dialog without aria-modal
items > 0 AND props = 0 | e schema MD001 Microdata itemscope without itemprop
rdfa > 0 AND vocabs = 0 | e schema RDFA001 RDFa attributes present but missing vocab
rdfa > 0 AND typeofs = 0 | e schema RDFA002 RDFa attributes present but missing typeof
searches = 0 | i seo OPSEARCH001 No OpenSearch description link found | i seo OPDESC001 Missing OpenSearch description
secure AND plain_scripts > 0 | c security MIXCONT001 Mixed content: active script | e security MIXSCR001 HTTP script sources on HTTPS page | w security MIXSCRIPT-V5001 HTTP script(s) on HTTPS page
secure AND plain_images > 0 | w security MIXCONT002 Mixed content: passive image | w security MIXIMG001 HTTP image sources on HTTPS page
secure AND plain_sheets > 0 | w security MIXCONT003 Mixed content: stylesheet/resource | w security MIXCSS-V5001 HTTP stylesheet(s) on HTTPS page
secure AND plain_frames > 0 | w security MIXCONT004 Mixed content: HTTP iframe | c security MIXIFRAME-V6068 Mixed content iframe detected
secure AND plain_forms > 0 | e security MIXFRM001 HTTP form action on HTTPS page | e security MIXED002 Form submissions over HTTP
secure AND plain_scripts + plain_images + plain_sheets + plain_frames > 0 | w security MIXED001 HTTP resources on HTTPS page
unlanguaged > 0 | e accessibility LANGATTR-V2001 Missing html lang | w accessibility LANGATTR-V2001-DEEP-DEEP Missing lang attribute (deep-deep)
blank_lang > 0 | e accessibility LANG003 Empty lang attribute
links = 0 | i links LINKSC001 No links on page
bare_links > 0 | e accessibility A11Y-LINK-V2001 Links with empty text | w links LINKTEXT001 Link with empty text | e accessibility LNKACC001 Link with empty text content | w links LINKTQ-V2002-V2 Empty link text | w links LINKEEMPTY-V6114 Empty link text | w links LINKTQ-V2001-DEEP Links without text (deep) | w links LINKTQ-V2001-DEEP-DEEP Links without text (deep-deep) | w links LINKSC003 Links without anchor text
vague_links > 0 | w links ANCHGEN001 Link with generic anchor text | w links LINKTEXT002 Link with generic text | w accessibility LNKACC002 Link with generic text | w links LINKTQ-V2001 Generic link text | w links ANCHGEN-V2001 Generic anchor text | w links LINKGEN-V6113 Generic link text | i links LINKTQ-V2002-DEEP Generic link text (deep) | i links ANCHGEN-V2001-DEEP Generic anchor text (deep)
own_bare_links > 0 | w links INTLINK-V2001 Internal links with no anchor text
links > 5 AND named_links > link_names | i links LINKDUP-V6115 Duplicate link text
own_names = 1 AND own_links > 1 | w links ANCH-DIV001 All internal links use identical anchor text
own_links >= 3 AND own_names / own_links < 0.3 | w links ANCH-V2001 Low anchor text diversity
wiki_links > 0 | i links WIKI001 Wikipedia links detected | i links WIKI-V2001 Wikipedia/Wikimedia links detected
wiki_unfollowed > 0 | i links WIKI-V2002 Wikipedia links marked nofollow
self_links > 0 | i links INTLINKQ001 Page contains self-links
followed_out > 10 | i links EXTLINKAUTH001 Many followed external links
out_bare_links > 0 | w links EXTLINKAUTH002 External links with empty anchor text
links > 0 AND unfollowed / links > 0.5 | w links LINKSC002 High nofollow link ratio
own_links >= 5 AND own_unfollowed / own_links > 0.30 | w links NOFOLLOW001 Excessive internal nofollow links
out_links >= 5 AND (out_links - followed_out) / out_links < 0.10 | i links NOFOLLOW002 Few external links use nofollow
"""


def rules() -> list[tuple[str, str, str, str, str]]:
    """Code, severity, category, title, condition."""
    return [(code, SEVERITY[s], category, title, when) for when, reports in _lines(RULES) for s, category, code, title in (r.split(" ", 3) for r in reports)]


def document_facts(planted: DataFrame) -> DataFrame:
    """page_id, url and the counts that RULES read. A link's name is its text, else its label or an image's alternative text."""
    node = lambda i: F.get(F.col("nodes"), i)
    host = urls.host(F.col("url"))

    def link(i: Column) -> Column:
        a = node(i)["attrs"]
        images = F.filter(F.coalesce(F.col("index")["img"], dom._no_ints()), lambda k: (k > i) & (k <= node(i)["last"]))
        named = F.array_join(F.transform(images, lambda k: F.coalesce(node(k)["attrs"]["alt"], F.lit(""))), " ")
        text = F.trim(F.regexp_replace(dom.text_of(i), r"\s+", " "))
        name = F.coalesce(F.nullif(text, F.lit("")), F.nullif(F.trim(a["aria-label"]), F.lit("")), F.trim(named))
        target = urls.join(F.col("url"), F.trim(a["href"]))
        return F.struct(F.lower(name).alias("name"), urls.host(target).alias("host"), F.regexp_replace(target, "#.*$", "").alias("target"), F.coalesce(F.lower(a["rel"]), F.lit("")).rlike(r"\bnofollow\b").alias("unfollowed"))

    counts = [F.size(dom.select(css)).cast("long").alias(name) for name, css in SELECTED.items()]
    rows = planted.select("page_id", "url", host.alias("host"), F.transform(dom.select("a[href]"), link).alias("l"), F.lower("url").startswith("https://").alias("secure"), *counts)
    n = lambda test=None: F.size(F.filter("l", test) if test else F.col("l")).cast("long")
    own, out = lambda x: x["host"] == F.col("host"), lambda x: x["host"] != F.col("host")
    names = lambda test: F.size(F.array_distinct(F.transform(F.filter("l", lambda x: test(x) & (x["name"] != "")), lambda x: x["name"]))).cast("long")
    wiki = lambda x: x["host"].rlike(r"(^|\.)(wikipedia|wikimedia|wikidata)\.org$")
    made = {
        "links": n(),
        "bare_links": n(lambda x: x["name"] == ""),
        "vague_links": n(lambda x: x["name"].isin(*GENERIC)),
        "named_links": n(lambda x: x["name"] != ""),
        "link_names": names(lambda x: F.lit(True)),
        "own_links": n(own),
        "own_names": names(own),
        "own_bare_links": n(lambda x: own(x) & (x["name"] == "")),
        "own_unfollowed": n(lambda x: own(x) & x["unfollowed"]),
        "out_links": n(out),
        "out_bare_links": n(lambda x: out(x) & (x["name"] == "")),
        "followed_out": n(lambda x: out(x) & ~x["unfollowed"]),
        "unfollowed": n(lambda x: x["unfollowed"]),
        "wiki_links": n(wiki),
        "wiki_unfollowed": n(lambda x: wiki(x) & x["unfollowed"]),
        "self_links": n(lambda x: x["target"] == F.regexp_replace(F.col("url"), "#.*$", "")),
    }
    return rows.select("page_id", "url", "secure", *SELECTED, *[v.alias(k) for k, v in made.items()])


def document_findings(facts: DataFrame) -> DataFrame:
    """page_id, url, code, severity, category, title of each rule that a page's tree breaks."""
    made = ", ".join(f"CASE WHEN {when} THEN named_struct('code', '{code}', 'severity', '{severity}', 'category', '{category}', 'title', '{title}') END" for code, severity, category, title, when in rules())
    return facts.select("page_id", "url", F.inline(F.expr(f"filter(array({made}), x -> x IS NOT NULL)")))


#: Markup put into pages by their number, as the given ones have none of it: divisor, remainder, what.
ADDED = [
    (2, 0, '<main><header>h</header></main>'),
    (6, 0, '<div role="main" aria-label="two">m</div>'),
    (5, 1, '<b tabindex="3">t</b><i tabindex="-1">a</i><i tabindex="-1">b</i><i tabindex="-2">c</i><i tabindex="-1">d</i><u tabindex="0">e</u>'),
    (7, 2, '<div role="progressbar">p</div><div role="slider" aria-valuenow="1" aria-valuemin="0">s</div><div role="tab">t</div>'),
    (7, 3, '<div role="combobox">c</div><div role="dialog">d</div><div role="tab" aria-selected="true" aria-label="x">t</div>'),
    (7, 4, '<div role="dialog" aria-modal="true" aria-labelledby="q">d</div><aside>s</aside>'),
    (4, 3, '<div itemscope="">m</div><p typeof="Product">r</p>'),
    (8, 5, '<div itemscope=""><b itemprop="name">m</b></div><p vocab="https://schema.org/" property="name">r</p>'),
    (3, 1, '<script src="http://c.example/a.js"></script><img src="http://c.example/i.png" alt="i"><link rel="search" href="http://c.example/o.xml">'),
    (9, 4, '<iframe src="http://c.example/f"></iframe><form action="http://c.example/g"></form>'),
    (5, 3, '<a href="/e"></a><a href="/v"> Read  More </a><a href="https://en.wikipedia.org/x" rel="nofollow"> w </a><a href="https://o.example/"><img src="/i.png" alt="pic"></a>'),
    (5, 4, "".join(f'<a href="https://o{k}.example/">same</a>' for k in range(12))),
]


def enriched(pages: DataFrame) -> DataFrame:
    """``pages`` with ADDED at the end of the body, and every seventh without the language of its text."""
    parts = [F.when(F.col("page_id") % n == r, F.lit(x)).otherwise(F.lit("")) for n, r, x in ADDED]
    page = F.coalesce("html", F.lit(""))
    page = F.when(F.col("page_id") % 7 == 6, F.regexp_replace(page, '<html lang="[^"]*">', "<html>")).otherwise(page)
    return pages.select("page_id", "url", F.concat(F.regexp_replace(page, "(?s)</body>.*$", ""), *parts).alias("html"))


def _fact_sql() -> str:
    """The same facts by patterns over the markup, for DuckDB; ``h`` is the page, ``x`` a link."""
    count = lambda p: f"len(regexp_extract_all(h, '{p}'))"
    facts = {
        "banners": count("<header"), "navs": count("<nav>"), "mains": count("<main>|role=\"main\""), "infos": count("<footer>"), "asides": count("<aside>"),
        "ahead": count("tabindex=\"[1-9]"), "aside_focus": count("tabindex=\"-"), "roles": count(" role=\""), "labels": count("aria-label"),
        "bars_open": count("role=\"progressbar\">"), "sliders_open": count("role=\"slider\" aria-valuenow=\"1\" aria-valuemin=\"0\">"), "combos_open": count("role=\"combobox\">"), "tabs_open": count("role=\"tab\">"),
        "dialogs": count("role=\"dialog\""), "modals": count("aria-modal"), "items": count("itemscope"), "props": count("itemprop"), "rdfa": count("<p (typeof|vocab)"), "vocabs": count(" vocab="), "typeofs": count(" typeof="),
        "searches": count("rel=\"search\""), "plain_scripts": count("<script src=\"http:"), "plain_images": count("<img src=\"http:"), "plain_sheets": count("<link rel=\"search\" href=\"http:"), "plain_frames": count("<iframe src=\"http:"), "plain_forms": count("<form action=\"http:"),
        "unlanguaged": f"CASE WHEN {count('<html lang=')} = 0 THEN 1 ELSE 0 END", "blank_lang": "0",
    }
    n = lambda test: f"len(list_filter(l, lambda x: {test}))"
    names = lambda test: f"len(list_distinct(list_transform(list_filter(l, lambda x: x.name <> '' AND {test}), lambda x: x.name)))"
    wiki = "ends_with(x.host, 'wikipedia.org')"
    links = {
        "links": "len(l)", "bare_links": n("x.name = ''"), "vague_links": n("x.name IN (" + ", ".join(f"'{g}'" for g in GENERIC) + ")"), "named_links": n("x.name <> ''"), "link_names": names("true"),
        "own_links": n("x.host = host"), "own_names": names("x.host = host"), "own_bare_links": n("x.host = host AND x.name = ''"), "own_unfollowed": n("x.host = host AND x.unfollowed"), "out_links": n("x.host <> host"), "out_bare_links": n("x.host <> host AND x.name = ''"),
        "followed_out": n("x.host <> host AND NOT x.unfollowed"), "unfollowed": n("x.unfollowed"), "wiki_links": n(wiki), "wiki_unfollowed": n(f"{wiki} AND x.unfollowed"), "self_links": n("x.target = regexp_replace(url, '#.*$', '')"),
    }
    return ", ".join(f"{v} AS {k}" for k, v in {**facts, **links}.items())


_added = " || ".join(f"CASE WHEN page_id % {n} = {r} THEN '{x}' ELSE '' END" for n, r, x in ADDED)
_text = "replace(replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_href = _text.replace("(x,", "(regexp_extract(x, 'href=\"([^\"]*)\"', 1),")
_target = html._duck_join("url", f"trim({_href})")
_made = ", ".join(f"CASE WHEN {when} THEN {{'code': '{code}', 'severity': '{severity}', 'category': '{category}', 'title': '{title}'}} END" for code, severity, category, title, when in rules())


@query(
    "document_rules",
    rf"""WITH d0 AS (SELECT page_id, url, {html._host('url')} AS host, starts_with(lower(url), 'https://') AS secure, CASE WHEN page_id % 7 = 6 THEN regexp_replace(coalesce(html, ''), '<html lang="[^"]*">', '<html>') ELSE coalesce(html, '') END AS g FROM pages),
    d1 AS (SELECT page_id, url, host, secure, regexp_replace(g, '(?s)</body>.*$', '') || {_added} AS h FROM d0),
    d2 AS (SELECT *, list_transform(regexp_extract_all(h, '<a href="[^>]*>.*?</a>'), lambda x: {{'name': lower(trim(regexp_replace({_text.replace("(x,", "(regexp_replace(regexp_replace(x, '<img [^>]*alt=\"([^\"]*)\">', '\\1', 'g'), '<[^>]*>', '', 'g'),")}, '\s+', ' ', 'g'))), 'host': {html._host(_target)}, 'target': regexp_replace({_target}, '#.*$', ''), 'unfollowed': contains(x, 'rel="nofollow"')}}) AS l FROM d1),
    d3 AS (SELECT page_id, url, secure, {_fact_sql()} FROM d2)
    SELECT page_id, url, unnest(list_filter([{_made}], lambda x: x IS NOT NULL), max_depth := 2) FROM d3""",
)
def document_rules(spark, sf_dir):
    """Findings on the tree of every page, with what ``enriched`` adds."""
    return document_findings(document_facts(dom.trees(enriched(texts(spark, sf_dir, "pages")))))
