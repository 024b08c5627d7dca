"""What selectors get out of pages: users' extraction rules, form controls and their labels, regions, outlines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom, elements
from .registry import query, texts


@dataclass(frozen=True)
class Rule:
    """A user's rule: ``attribute`` is text, html or the name of an attribute."""

    name: str
    selector: str
    attribute: str = "text"
    regex: str | None = None
    capture_group: int = 0
    default: str = ""
    max_length: int | None = None


def _matched(value: Column, rule: Rule) -> Column:
    """The rule's group of its pattern in ``value``, or its default; a pattern that is none always gives the default."""
    try:
        groups = re.compile(rule.regex).groups
    except re.error:
        groups = -1
    if rule.capture_group > groups:
        return F.lit(rule.default)
    return F.when(value.rlike(rule.regex), F.regexp_extract(value, rule.regex, rule.capture_group)).otherwise(F.lit(rule.default))


def _values(rule: Rule) -> Column:
    def value(i: Column) -> Column:
        if rule.attribute == "text":
            raw = dom.text_of(i)
        elif rule.attribute == "html":
            raw = dom.inner_html(i)
        else:
            raw = F.coalesce(dom.attribute(i, rule.attribute), F.lit(rule.default))
        return raw if rule.regex is None else _matched(raw, rule)

    found = F.transform(dom.select(rule.selector), value)
    if rule.max_length is not None:
        most = rule.max_length
        found = F.transform(found, lambda x: F.when(F.octet_length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x))
    return F.filter(found, lambda x: x != "")


def extracted(planted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, rule_name, values: for each page and rule the values of all selected elements, in order.

    Empty values go; where none is left there is one, the rule's default. Values of more bytes than ``max_length`` are
    cut to as many characters and three dots. A rule whose selector is none gives no rows. Without rules there are none.
    """
    known = []
    for rule in rules:
        try:
            dom.compiled(rule.selector)
        except dom.SelectorError:
            continue
        known.append(rule)
    if not known:
        return planted.select("page_id", F.lit("").alias("rule_name"), F.array(F.lit("")).alias("values")).where("false")
    each = [F.struct(F.lit(r.name).alias("rule_name"), _values(r).alias("values"), F.lit(r.default).alias("default")) for r in known]
    rows = planted.select("page_id", F.explode(F.array(*each)).alias("r"))
    return rows.select("page_id", "r.rule_name", F.when(F.size("r.values") > 0, F.col("r.values")).otherwise(F.array("r.default")).alias("values"))


RULES = [
    Rule("title", "article > h1"),
    Rule("sections", "nav > ul > li > a[href]", "href", r"^/([a-z]+)", 1, "", 4),
    Rule("advert", "body > div.ad", "html", max_length=20),
    Rule("second", "article > p:nth-of-type(2)", regex="[a-zA-Z]+", default="none"),
    Rule("missing", "article[data-x]", "data-x", default="nothing"),
    Rule("broken", "a >> b"),
]
_UNESCAPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
_CUT = "list_transform({v}, lambda v: CASE WHEN strlen(v) > {n} THEN substr(v, 1, {n}) || '...' ELSE v END)"
_OR = "CASE WHEN len({v}) > 0 THEN {v} ELSE ['{d}'] END"


@query(
    "extraction_rules",
    rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    v AS (SELECT page_id,
      list_filter(list_transform(regexp_extract_all(h, '<article><h1>([^<]*)', 1), lambda x: {_UNESCAPED.format(x='x')}), lambda x: x <> '') AS title,
      list_filter(list_transform(list_transform(regexp_extract_all(regexp_extract(h, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1), lambda x: {_UNESCAPED.format(x='x')}), lambda x: regexp_extract(x, '^/([a-z]+)', 1)), lambda x: x <> '') AS sections,
      list_filter(regexp_extract_all(h, '(?s)<div class="ad">(.*?)</div>', 1), lambda x: x <> '') AS advert,
      CASE WHEN array_length(string_split(regexp_extract(h, '(?s)<article>(.*?)(</article>|$)', 1), '<p>')) > 2 THEN [{_UNESCAPED.format(x="regexp_replace(string_split(regexp_extract(h, '(?s)<article>(.*?)(</article>|$)', 1), '<p>')[3], '<[^>]*>', '', 'g')")}] ELSE [] END AS second
    FROM p)
    SELECT page_id, 'title' AS rule_name, {_OR.format(v='title', d='')} AS values FROM v
    UNION ALL SELECT page_id, 'sections', {_OR.format(v=_CUT.format(v='sections', n=4), d='')} FROM v
    UNION ALL SELECT page_id, 'advert', {_OR.format(v=_CUT.format(v='advert', n=20), d='')} FROM v
    UNION ALL SELECT page_id, 'second', {_OR.format(v="list_filter(list_transform(second, lambda x: CASE WHEN regexp_matches(x, '[a-zA-Z]') THEN regexp_extract(x, '[a-zA-Z]+') ELSE 'none' END), lambda x: x <> '')", d='none')} FROM v
    UNION ALL SELECT page_id, 'missing', ['nothing'] FROM v""",
)
def extraction_rules(spark, sf_dir):
    """Rules of a user over every page: texts, attributes and source, patterns, defaults and cuts; one rule is broken."""
    return extracted(dom.trees(texts(spark, sf_dir, "pages")), RULES)


SELECTORS = {
    "nav_links": "nav > ul li a[href]",
    "later_items": "li:first-child ~ li",
    "second_link": "li:first-child + li > a",
    "odd_items": "nav li:nth-child(odd)",
    "last_item": "ul > li:last-child",
    "paragraphs": "article p",
    "no_paragraphs": "nav p, footer p",
    "adverts": "body > .ad, div[class~='ad'], div[class^=a]",
    "not_items": "nav :not(li):not(a)",
    "charset": "head > meta[charset=\"UTF-8\" i]",
    "languages": "html:is([lang|=en], [lang=de])",
}


@query(
    "dom_select",
    r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS art FROM pages),
    n AS (SELECT *, len(regexp_extract_all(nav, '<li>')) AS items, string_split(art, '<p>')[2:] AS paras FROM p)
    SELECT page_id, len(regexp_extract_all(nav, '<a href=')) AS nav_links, greatest(items - 1, 0) AS later_items, CASE WHEN items > 1 THEN 1 ELSE 0 END AS second_link,
      (items + 1) // 2 AS odd_items, least(items, 1) AS last_item, len(paras) AS paragraphs, 0 AS no_paragraphs,
      len(regexp_extract_all(h, '<div class="ad">')) AS adverts, least(len(regexp_extract_all(nav, '<ul>')), 1) AS not_items, len(regexp_extract_all(h, '<meta charset="utf-8">')) AS charset,
      CASE WHEN regexp_matches(h, '<html lang="(en|de)">') THEN 1 ELSE 0 END AS languages
    FROM n""",
)
def dom_select(spark, sf_dir):
    """How many nodes each of SELECTORS selects on every page."""
    planted = dom.trees(texts(spark, sf_dir, "pages"))
    return planted.select("page_id", *[F.size(dom.select(css)).cast("long").alias(name) for name, css in SELECTORS.items()])


#: Parts of a page, by selector.
REGIONS = {"head": "head > title", "nav": "nav, [role=navigation]", "main": "main, article, [role=main]", "aside": "aside, [role=complementary]", "footer": "body > footer, [role=contentinfo]", "advert": "div.ad, div.advert"}


def regions(planted: DataFrame) -> DataFrame:
    """page_id, region, nodes, words: how many elements each region of a page has, and the words in them."""
    def one(name: str, css: str) -> Column:
        words = F.aggregate(F.transform(dom.select(css), lambda i: F.size(F.filter(F.split(dom.text_of(i), r"\s+"), lambda w: w != ""))), F.lit(0), lambda a, x: a + x)
        return F.struct(F.lit(name).alias("region"), F.size(dom.select(css)).cast("long").alias("nodes"), words.cast("long").alias("words"))

    return planted.select("page_id", F.explode(F.array(*[one(*x) for x in REGIONS.items()])).alias("r")).select("page_id", "r.*")


def _words_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(regexp_replace({x}, '<[^>]*>', '', 'g'), '\\s+'), lambda w: w <> ''))"


@query(
    "dom_regions",
    rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    r AS (SELECT page_id, unnest(['head', 'nav', 'main', 'footer', 'advert']) AS region, unnest([regexp_extract_all(h, '(?s)<title>(.*?)</title>', 1), regexp_extract_all(h, '(?s)<nav>(.*?)</nav>', 1), regexp_extract_all(h, '(?s)<article>(.*?)</article>', 1), regexp_extract_all(h, '(?s)<footer>(.*?)</footer>', 1), regexp_extract_all(h, '(?s)<div class="ad">(.*?)</div>', 1)]) AS parts FROM p)
    SELECT page_id, region, len(parts) AS nodes, CAST(coalesce(list_sum(list_transform(parts, lambda x: {_words_sql('x')})), 0) AS BIGINT) AS words FROM r
    UNION ALL SELECT page_id, 'aside', 0, 0 FROM pages""",
)
def dom_regions(spark, sf_dir):
    """Words in the regions of every page."""
    return regions(dom.trees(texts(spark, sf_dir, "pages")))


def form_controls(planted: DataFrame) -> DataFrame:
    """A row for each form and each of its inputs, selects and text areas: how it is labelled.

    page_id, form (its number on the page), action, method, has_fieldset, has_legend, control (its number in the form),
    type, name, id, required, explicit_label (a label of the form names its id), implicit_label (it is inside a label of
    the form), aria_label, has_label. A form without controls has no row.
    """
    nodes = F.col("nodes")
    node = lambda i: F.get(nodes, i)
    inside = lambda i, css: F.filter(dom.select(css), lambda x: (x > i) & (x <= node(i)["last"]))
    forms = planted.select("page_id", "nodes", "index", F.posexplode(dom.select("form")).alias("form", "f"))
    f = F.col("f")
    forms = forms.select(
        "*",
        node(f)["attrs"]["action"].alias("action"),
        F.lower(F.coalesce(node(f)["attrs"]["method"], F.lit("get"))).alias("method"),
        (F.size(inside(f, "fieldset")) > 0).alias("has_fieldset"),
        (F.size(inside(f, "legend")) > 0).alias("has_legend"),
        inside(f, "label").alias("labels"),
        inside(f, "input, select, textarea").alias("controls"),
    )
    rows = forms.select("*", F.posexplode("controls").alias("control", "c"), F.transform("labels", lambda i: node(i)["attrs"]["for"]).alias("targets"))
    a = node(F.col("c"))["attrs"]
    explicit = F.coalesce(F.array_contains("targets", a["id"]), F.lit(False))
    implicit = F.exists("labels", lambda i: (i < F.col("c")) & (F.col("c") <= node(i)["last"]))
    return rows.select(
        "page_id",
        "form",
        "action",
        "method",
        "has_fieldset",
        "has_legend",
        "control",
        a["type"].alias("type"),
        a["name"].alias("name"),
        a["id"].alias("id"),
        (a["required"].isNotNull() | F.coalesce(a["aria-required"] == "true", F.lit(False))).alias("required"),
        explicit.alias("explicit_label"),
        implicit.alias("implicit_label"),
        a["aria-label"].alias("aria_label"),
        (explicit | implicit | a["aria-label"].isNotNull() | a["aria-labelledby"].isNotNull()).alias("has_label"),
    )


_CONTROLS = """(3, 0, '/go', false, 0, NULL, 'q', 'q', true, true, false, NULL), (3, 0, '/go', false, 1, 'hidden', 't', NULL, false, false, false, NULL), (3, 0, '/go', false, 2, 'text', NULL, 'q', false, true, false, NULL), (3, 0, '/go', false, 3, NULL, 'n', NULL, false, false, true, NULL),
(4, 3, NULL, false, 0, NULL, 'a', NULL, false, false, false, NULL), (4, 3, NULL, false, 1, NULL, 'b', NULL, true, false, false, 'B'), (4, 3, NULL, false, 2, NULL, 'c', NULL, false, false, false, NULL), (4, 3, NULL, false, 3, NULL, 'd', NULL, false, false, false, NULL), (4, 3, NULL, false, 4, 'submit', NULL, NULL, false, false, false, NULL),
(7, 2, 'x', true, 0, NULL, 'r', NULL, true, false, false, NULL)"""


@query(
    "form_controls",
    f"""WITH k(n, r, action, has_fieldset, control, type, name, id, required, explicit_label, implicit_label, aria_label) AS (VALUES {_CONTROLS})
    SELECT page_id, CASE n WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 4 = 3 THEN 1 ELSE 0 END END AS form,
      action, 'get' AS method, has_fieldset, false AS has_legend, control, type, name, id, required, explicit_label, implicit_label, aria_label, (explicit_label OR implicit_label OR aria_label IS NOT NULL) AS has_label
    FROM pages JOIN k ON page_id % n = r WHERE contains(html, '</body>')""",
)
def form_controls_query(spark, sf_dir):
    """Controls of the forms on every page, with what ``enriched`` adds."""
    return form_controls(dom.trees(elements.enriched(texts(spark, sf_dir, "pages"))))
