"""Style sheets of pages cascaded over their trees, and the contrast of texts that comes of it.

Everything happens inside a page's row: the sheets are cut into rules and selectors with text functions, each
selector is matched from its last part, whose nodes the tree's index knows, up to its first by intervals and
parents; declarations win by importance, place, specificity and order, and what a node does not declare comes
from the nearest interval around it that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .functions.scalars import luminance
from .registry import query, texts

#: Colour names (the sixteen of old and orange), with their hex digits.
NAMED = {
    "aqua": "00ffff", "black": "000000", "blue": "0000ff", "fuchsia": "ff00ff", "gray": "808080", "grey": "808080",
    "green": "008000", "lime": "00ff00", "maroon": "800000", "navy": "000080", "olive": "808000", "orange": "ffa500",
    "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "white": "ffffff", "yellow": "ffff00",
}
#: What browsers set before any sheet: property, elements, value.
BROWSER = [("font-size", "h1", "2em"), ("font-size", "h2", "1.5em"), ("font-size", "h3", "1.17em"), *[("font-weight", t, "bold") for t in "h1 h2 h3 h4 h5 h6 b strong th".split()], ("color", "a", "#0000ee")]
#: Least contrast of texts, of large ones, and from how many pixels on texts are large, bold or not.
LEAST, LEAST_LARGE, LARGE_BOLD, LARGE = 4.5, 3.0, 18.66, 24.0
PROPERTIES = ("color", "background-color", "font-size", "font-weight")
_WITHOUT = ("inherit", "initial", "unset", "revert", "currentcolor")
_SILENT = "head style script noscript template title iframe".split()


def _declarations(body: Column) -> Column:
    """property, value and important of what a rule's body declares of PROPERTIES; ``background`` counts for its colour."""

    def one(text: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(text, ":", 1)))
        value = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "^[^:]*:", ""), r"(?i)!\s*important", "")))
        colour = F.regexp_extract(value, r"(#[0-9a-f]{3,8}\b|rgba?\([^)]*\)|\b(?:" + "|".join([*NAMED, "transparent", "inherit"]) + r")\b)", 1)
        short = name == "background"
        # a background with anything else in it, such as a picture or a gradient, is not known
        plain = F.when(F.trim(value) == "none", F.lit("transparent")).when(value.rlike(r"url\(|gradient\(|var\("), F.lit("?")).otherwise(colour)
        return F.struct(F.when(short, F.lit("background-color")).otherwise(name).alias("property"), F.when(short, plain).otherwise(value).alias("value"), text.rlike(r"(?i)!\s*important").cast("int").alias("important"))

    return F.filter(F.transform(F.split(body, ";"), one), lambda d: d["property"].isin(*PROPERTIES) & (d["value"] != ""))


def _steps(selector: Column) -> Column:
    """A selector's steps from the left; each token is a combinator and a compound."""
    text = F.regexp_replace(F.regexp_replace(F.trim(selector), r"\s*>\s*", ">"), r"\s+", " ")

    def one(token: Column) -> Column:
        sign = F.substring(token, 1, 1)
        compound = F.regexp_replace(token, "^[ >]", "")
        return F.struct(
            F.when(sign.isin(" ", ">"), sign).otherwise(F.lit("")).alias("combinator"),
            F.nullif(F.lower(F.regexp_extract(compound, r"^([a-zA-Z][\w-]*)", 1)), F.lit("")).alias("tag"),
            F.nullif(F.regexp_extract(compound, r"#([^.#\s]+)", 1), F.lit("")).alias("id"),
            F.regexp_extract_all(compound, F.lit(r"\.([^.#\s]+)"), 1).alias("classes"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit("(^|[ >])([^ >]+)"), 0), one)


def rules(sheet: Column) -> Column:
    """Rules of a sheet in order: place, weight (specificity), steps, declarations.

    Types, ids, classes, descendants and children; a selector with anything else (states, attributes, siblings) selects
    nothing here. Blocks of ``@media`` other than print count as if they applied; key frames, fonts and pages do not.
    """
    text = F.regexp_replace(sheet, r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"(?is)@(?:[\w-]*keyframes|font-face|page|media\s+print)\b[^{;]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?is)@(?:import|charset|namespace)[^;{]*;", " "), r"(?is)@(?:media|supports|layer|container)\b[^{;]*\{", " ")
    blocks = F.regexp_extract_all(text, F.lit(r"([^{}]+)\{([^{}]*)\}"), 0)

    def one(block: Column, k: Column) -> Column:
        names = F.filter(F.split(F.substring_index(block, "{", 1), ","), lambda s: (F.trim(s) != "") & ~s.rlike(r"[+~:\[(\\]"))
        body = _declarations(F.regexp_replace(F.regexp_replace(block, r"(?s)^[^{]*\{", ""), r"\}$", ""))

        def selected(s: Column) -> Column:
            return dom._let(_steps(s), lambda steps: F.struct(k.alias("place"), F.aggregate(steps, F.lit(0), lambda w, t: w + t["id"].isNotNull().cast("int") * 1_000_000 + F.size(t["classes"]) * 1000 + t["tag"].isNotNull().cast("int")).alias("weight"), steps.alias("steps"), body.alias("declarations")))

        return F.transform(names, selected)

    return F.filter(F.flatten(F.transform(blocks, one)), lambda r: (F.size(r["steps"]) > 0) & (F.size(r["declarations"]) > 0))


def _fits(node: Column, step: Column) -> Column:
    names = F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"[ \t\n\f\r]+")
    tag = step["tag"].isNull() | (node["tag"] == step["tag"])
    return tag & F.coalesce(step["id"].isNull() | (node["attrs"]["id"] == step["id"]), F.lit(False)) & F.forall(step["classes"], lambda c: F.array_contains(names, c))


def _known(step: Column) -> Column:
    """Nodes that may fit a step."""
    key = F.coalesce(F.concat(F.lit("#"), step["id"]), F.concat(F.lit("."), F.get(step["classes"], F.lit(0))), step["tag"])
    return F.when(key.isNull(), dom._ints(F.lit(0), F.size("nodes"))).otherwise(F.coalesce(F.col("index")[key], dom._no_ints()))


def _matches(steps: Column) -> Column:
    """The nodes that a selector's steps end at, found from the last step up."""
    node = lambda i: F.get(F.col("nodes"), i)
    last = F.element_at(steps, -1)

    def climbs(x: Column) -> Column:
        start = F.struct(F.array(x).alias("at"), last["combinator"].alias("by"))

        def up(s: Column, step: Column) -> Column:
            parents = F.filter(F.transform(s["at"], lambda i: node(i)["parent"]), lambda p: (p >= 0) & _fits(node(p), step))
            around = F.filter(_known(step), lambda a: _fits(node(a), step) & F.exists(s["at"], lambda i: (a < i) & (i <= node(a)["last"])))
            return F.struct(F.when(s["by"] == ">", parents).otherwise(around).alias("at"), step["combinator"].alias("by"))

        earlier = F.reverse(F.slice(steps, F.lit(1), F.size(steps) - 1))
        return F.size(F.aggregate(earlier, start, up)["at"]) > 0

    return F.filter(_known(last), lambda i: _fits(node(i), last) & climbs(i))


def _winners(declared: Column, name: str) -> Column:
    """node and value of the declaration of a property that wins on each node."""
    own = F.filter(declared, lambda d: d["property"] == name)
    order = F.sort_array(F.transform(own, lambda d: F.struct(d["node"].alias("node"), d["important"].alias("important"), d["inline"].alias("inline"), d["weight"].alias("weight"), d["place"].alias("place"), d["value"].alias("value"))))
    last = dom._let(order, lambda a: F.filter(a, lambda d, k: (k == F.size(a) - 1) | (F.get(a, k + 1)["node"] != d["node"])))
    return F.filter(last, lambda d: ~d["value"].isin(*_WITHOUT))


def _with_nodes(nodes: Column, rest: list[Column]) -> Column:
    return F.transform(nodes, lambda i: F.struct(i.alias("node"), *rest))


def cascaded(planted: DataFrame) -> DataFrame:
    """``planted`` (of ``dom.trees``) with a column for each of PROPERTIES: the nodes that declare it, in order, and what wins on each."""
    sheets = F.array_join(F.transform(dom.select("style"), lambda i: dom.text_of(i)), "\n")
    rows = planted.withColumn("rules", rules(sheets))
    matched = F.transform(
        "rules",
        lambda r: F.flatten(
            F.transform(
                _matches(r["steps"]),
                lambda i: F.transform(r["declarations"], lambda d, k: F.struct(i.alias("node"), d["property"].alias("property"), d["important"].alias("important"), F.lit(0).alias("inline"), r["weight"].alias("weight"), (r["place"] * 1000 + k).alias("place"), d["value"].alias("value"))),
            )
        ),
    )
    inline = F.transform(
        dom.select("[style]"),
        lambda i: F.transform(_declarations(dom.attribute(i, "style")), lambda d, k: F.struct(i.alias("node"), d["property"].alias("property"), d["important"].alias("important"), F.lit(1).alias("inline"), F.lit(0).alias("weight"), k.alias("place"), d["value"].alias("value"))),
    )
    first = []
    for name, tag, value in BROWSER:
        nodes = dom.select("a[href]") if tag == "a" else F.coalesce(F.col("index")[tag], dom._no_ints())
        rest = [F.lit(x).alias(k) for k, x in (("property", name), ("important", 0), ("inline", -1), ("weight", 0), ("place", 0), ("value", value))]
        first.append(_with_nodes(nodes, rest))
    rows = rows.withColumn("declared", F.concat(F.flatten(matched), F.flatten(inline), *first))
    return rows.select(*planted.columns, *[_winners(F.col("declared"), name).alias(name.replace("-", "_")) for name in PROPERTIES])


def channels(value: Column) -> Column:
    """Red, green and blue of an opaque colour; null for others and for what is no colour."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])[value]
    digits = F.coalesce(named, F.regexp_extract(value, "^#([0-9a-f]{6}|[0-9a-f]{3})$", 1))
    long = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    numbers = F.regexp_extract_all(F.regexp_extract(value, r"^rgba?\(([^)]*)\)$", 1), F.lit(r"(\d+(?:\.\d+)?%?)"), 1)
    level = lambda x: F.least(F.when(x.endswith("%"), F.round(F.rtrim(F.replace(x, F.lit("%"), F.lit(""))).try_cast("double") * 2.55)).otherwise(F.round(x.try_cast("double"))), F.lit(255.0)).cast("int")
    opaque = (F.size(numbers) == 3) | ((F.size(numbers) == 4) & (F.get(numbers, F.lit(3)).isin("1", "1.0", "100%")))
    return F.when(F.length(long) == 6, F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda k: F.conv(long.substr(k, F.lit(2)), 16, 10).cast("int"))).when(opaque, F.transform(F.slice(numbers, 1, 3), level))


def _around(winners: str, i: Column) -> Column:
    """The declarations of node ``i`` and the nodes around it, from the outermost in."""
    return F.filter(winners, lambda d: (d["node"] <= i) & (i <= F.get(F.col("nodes"), d["node"])["last"]))


def _pixels(i: Column) -> Column:
    def one(px: Column, d: Column) -> Column:
        number = F.regexp_extract(d["value"], r"^(\d*\.?\d+)(px|pt|r?em|%)$", 1).try_cast("double")
        unit = F.regexp_extract(d["value"], r"^(\d*\.?\d+)(px|pt|r?em|%)$", 2)
        return F.when(unit == "px", number).when(unit == "pt", number * 4 / 3).when(unit == "rem", number * 16).when(unit == "em", px * number).when(unit == "%", px * number / 100).otherwise(px)

    return F.aggregate(_around("font_size", i), F.lit(16.0).cast("double"), one)


def text_colors(planted: DataFrame) -> DataFrame:
    """A row for each piece of text that a page shows, with its colours and contrast.

    page_id, node, tag, linked (inside a link), text, color, background, pixels, bold, ratio (null where a colour is not known,
    such as a picture behind the text), enough.
    """
    shown = F.filter(F.arrays_zip(F.col("owners"), F.col("pieces")), lambda z: (F.trim(F.regexp_replace(z["pieces"], r"\s+", " ")) != "") & ~F.exists(F.flatten(F.array(*[F.coalesce(F.col("index")[t], dom._no_ints()) for t in _SILENT])), lambda a: (a <= z["owners"]) & (z["owners"] <= F.get(F.col("nodes"), a)["last"])))
    nearest = lambda found: F.element_at(found, -1)["value"]

    def one(z: Column) -> Column:
        i = z["owners"]
        return F.struct(
            i.alias("node"),
            F.get("nodes", i)["tag"].alias("tag"),
            F.exists(F.coalesce(F.col("index")["a"], dom._no_ints()), lambda a: (a <= i) & (i <= F.get(F.col("nodes"), a)["last"])).alias("linked"),
            F.trim(F.regexp_replace(z["pieces"], r"\s+", " ")).alias("text"),
            F.coalesce(nearest(F.concat(_black, _around("color", i))), F.lit("#000000")).alias("color"),
            F.coalesce(nearest(F.concat(_white, F.filter(_around("background_color", i), lambda d: d["value"] != "transparent"))), F.lit("#ffffff")).alias("background"),
            _pixels(i).alias("pixels"),
            nearest(F.concat(_plain, _around("font_weight", i))).rlike("^(bold|bolder|[7-9]00)$").alias("bold"),
        )

    _black, _white, _plain = (F.array(F.struct(F.lit(0).alias("node"), F.lit(0).alias("important"), F.lit(0).alias("inline"), F.lit(0).alias("weight"), F.lit(0).alias("place"), F.lit(x).alias("value"))) for x in ("#000000", "#ffffff", "normal"))
    # a page's arrays stay in its row: only what each text comes to is made a row
    rows = cascaded(planted).select("page_id", F.explode(F.transform(shown, one)).alias("t")).select("page_id", "t.*")
    rows = rows.withColumns({"x": luminance(channels(F.col("color"))), "y": luminance(channels(F.col("background")))})
    ratio = (F.greatest("x", "y") + 0.05) / (F.least("x", "y") + 0.05)
    large = (F.col("pixels") >= LARGE) | (F.col("bold") & (F.col("pixels") >= LARGE_BOLD))
    ratio = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), ratio)
    return rows.withColumn("ratio", ratio).withColumn("enough", F.col("ratio") >= F.when(large, LEAST_LARGE).otherwise(LEAST)).drop("x", "y")


def contrast_findings(planted: DataFrame) -> DataFrame:
    """page_id, code, severity, texts (how many have too little contrast), worst: COLRCT001 for texts, COLRCL001 for those in links."""
    low = text_colors(planted).where(~F.col("enough"))
    return low.groupBy("page_id", F.when(F.col("linked"), "COLRCL001").otherwise("COLRCT001").alias("code")).agg(F.count("*").alias("texts"), F.round(F.min("ratio"), 2).alias("worst")).withColumn("severity", F.lit("warning"))


#: Sheets that pages get by their number, as the given ones set a margin only.
SHEETS = [
    "@media screen { nav > ul li > a { color: #999 } } article > p { color: gray !important } p { color: #fff } div.ad { background: #eee; color: rgb(200, 200, 200) } .ad { color: #ddd } a:hover { color: red }",
    "/* body { color: red } */ footer { background: #333; color: #444 } article h1 { color: #949494 } body { background-color: white } @media print { p { color: #fff } } nav { background: url(x.png) }",
]


@query(
    "css_contrast",
    rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(coalesce(html, ''), '(?s)</h1>(.*?)(</article>|$)', 1) AS art,
      regexp_extract(coalesce(html, ''), '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(coalesce(html, ''), '(?s)<footer>(.*?)</footer>', 1) AS foot, regexp_extract(coalesce(html, ''), '(?s)<article><h1>(.*?)</h1>', 1) AS h1 FROM pages),
    n AS (SELECT page_id, page_id % 3 AS k, {', '.join(rf"len(list_filter(regexp_split_to_array({x}, '<[^>]*>'), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g')) <> '')) AS {x}" for x in ('nav', 'art', 'ad', 'foot', 'h1'))} FROM p)
    SELECT page_id, 'COLRCL001' AS code, 'warning' AS severity, nav AS texts, 2.85::DOUBLE AS worst FROM n WHERE k = 1 AND nav > 0
    UNION ALL SELECT page_id, 'COLRCT001', 'warning', art + ad, CASE WHEN ad > 0 THEN 1.44 ELSE 3.95 END FROM n WHERE k = 1 AND art + ad > 0
    UNION ALL SELECT page_id, 'COLRCT001', 'warning', foot, 1.3 FROM n WHERE k = 2 AND foot > 0""",
)
def css_contrast(spark, sf_dir):
    """Texts of too little contrast on every page, with the sheets of SHEETS put into two pages of three."""
    page = F.coalesce("html", F.lit(""))
    sheet = F.when(F.col("page_id") % 3 == 1, f"<style>{SHEETS[0]}</style></head>").when(F.col("page_id") % 3 == 2, f"<style>{SHEETS[1]}</style></head>").otherwise("</head>")
    pages = texts(spark, sf_dir, "pages").select("page_id", "url", F.replace(page, F.lit("</head>"), sheet).alias("html"))
    return contrast_findings(dom.trees(pages))
