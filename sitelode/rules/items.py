"""JSON-LD as a graph of items: nested to any depth, with references by ``@id`` resolved.

Every block is taken apart level by level (``variant_explode``), so that depth costs rounds, not code; items are
the objects in it, their edges are what they hold or name. A reference is an object with nothing but an
``@id``; it stands for the item of its page that has that id and says more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from ..registry import query, table


def nodes(blocks: DataFrame) -> DataFrame:
    """page_id, block, path, owner, property, kind, value of every value in ``blocks`` (page_id, block, json), at any depth.

    ``owner`` is the path of the nearest object around a value and ``property`` the name by which that holds it, lists left
    out; kind is object, list or scalar, ``value`` a scalar's text. A block that is no JSON has no rows.
    """
    spark = blocks.sparkSession
    kind = F.substring(F.schema_of_variant("v"), 1, 6)
    # OBJECT<...> and ARRAY<...>, whatever is in them
    kinds = F.when(kind == "OBJECT", "object").when(kind == "ARRAY<", "list").otherwise("scalar").alias("kind")
    none = F.lit(None).cast("string")
    level = blocks.select("page_id", "block", F.lit("$").alias("path"), none.alias("owner"), none.alias("property"), F.try_parse_json("json").alias("v")).where("v IS NOT NULL").select("*", kinds)
    done = []
    while True:
        level = cut(level)
        done.append(level.select("page_id", "block", "path", "owner", "property", "kind", F.when(F.col("kind") == "scalar", F.variant_get("v", "$", "string")).alias("value")))
        held = level.where("kind <> 'scalar'")
        if held.isEmpty():
            break
        inside = held.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        is_object = F.col("kind") == "object"
        level = inside.select(
            "page_id",
            "block",
            F.concat_ws("/", "path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"),
            F.when(is_object, F.col("path")).otherwise(F.col("owner")).alias("owner"),
            F.when(is_object, F.col("key")).otherwise(F.col("property")).alias("property"),
            F.col("value").alias("v"),
        ).select("*", kinds)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def items(found: DataFrame) -> DataFrame:
    """The objects of ``nodes``: page_id, block, path, owner, property, types (in order of their names), id, properties (how many names), target.

    ``target`` is the item itself, or for a reference the item of its page that it names, the first by block and path; a
    reference to what is not there is its own target.
    """
    place = ["page_id", "block", "path"]
    said = found.where("owner IS NOT NULL").groupBy("page_id", "block", F.col("owner").alias("path"))
    said = said.agg(
        F.sort_array(F.collect_list(F.when((F.col("property") == "@type") & (F.col("kind") == "scalar"), F.col("value")))).alias("types"),
        F.max(F.when((F.col("property") == "@id") & (F.col("kind") == "scalar"), F.col("value"))).alias("id"),
        F.countDistinct("property").alias("properties"),
    )
    each = found.where("kind = 'object'").select(*place, "owner", "property").join(said, place, "left")
    each = each.withColumns({"types": F.coalesce("types", F.expr("cast(array() as array<string>)")), "properties": F.coalesce("properties", F.lit(0))})
    named = each.where("id IS NOT NULL AND properties > 1").groupBy("page_id", "id").agg(F.min(F.struct("block", "path")).alias("named"))
    reference = (F.col("properties") == 1) & F.col("id").isNotNull()
    own = F.struct(F.col("block"), F.col("path"))
    return each.join(named, ["page_id", "id"], "left").withColumn("target", F.when(reference & F.col("named").isNotNull(), F.col("named")).otherwise(own)).drop("named")


def _scalars(found: DataFrame, names: list[str]) -> DataFrame:
    """For each object the least text of each named property that is a scalar."""
    rows = found.where((F.col("kind") == "scalar") & F.col("property").isin(names))
    return rows.groupBy("page_id", "block", F.col("owner").alias("path")).agg(*[F.min(F.when(F.col("property") == n, F.col("value"))).alias(n) for n in names])


def offers(found: DataFrame) -> DataFrame:
    """page_id, product, price, currency, availability of each offer of each Product, wherever both stand.

    An offer without a price has that of its priceSpecification; the part of availability after the last slash counts.
    """
    each = items(found)
    told = _scalars(found, ["name", "price", "priceCurrency", "availability"])
    at = lambda prefix: (F.col(f"{prefix}.block"), F.col(f"{prefix}.path"))
    products = each.where(F.array_contains("types", "Product")).select("page_id", F.col("block").alias("p_block"), F.col("path").alias("p_path"))
    names = told.select("page_id", F.col("block").alias("p_block"), F.col("path").alias("p_path"), F.col("name").alias("product"))
    products = products.join(names, ["page_id", "p_block", "p_path"], "left")
    held = each.select("page_id", F.col("block").alias("p_block"), F.col("owner").alias("p_path"), "property", *[c.alias(n) for n, c in zip(("block", "path"), at("target"))])
    sold = products.join(held.where("property = 'offers'").drop("property"), ["page_id", "p_block", "p_path"])
    specified = held.where("property = 'priceSpecification'").select("page_id", F.col("p_block").alias("block"), F.col("p_path").alias("path"), F.col("block").alias("s_block"), F.col("path").alias("s_path"))
    prices = told.select("page_id", F.col("block").alias("s_block"), F.col("path").alias("s_path"), F.col("price").alias("s_price"), F.col("priceCurrency").alias("s_currency"))
    inner = specified.join(prices, ["page_id", "s_block", "s_path"]).groupBy("page_id", "block", "path").agg(F.min("s_price").alias("s_price"), F.min("s_currency").alias("s_currency"))
    rows = sold.join(told.drop("name"), ["page_id", "block", "path"], "left").join(inner, ["page_id", "block", "path"], "left")
    return rows.select("page_id", "product", F.coalesce("price", "s_price").alias("price"), F.coalesce("priceCurrency", "s_currency").alias("currency"), F.substring_index("availability", "/", -1).alias("availability"))


def dates(found: DataFrame) -> DataFrame:
    """page_id, published, modified: the earliest datePublished and the latest dateModified on a page, at any depth (texts that are no dates do not count)."""
    when = F.when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("value", 1, 10).try_cast("date"))
    rows = found.where((F.col("kind") == "scalar") & F.col("property").isin("datePublished", "dateModified")).withColumn("day", when)
    return rows.groupBy("page_id").agg(F.min(F.when(F.col("property") == "datePublished", F.col("day"))).alias("published"), F.max(F.when(F.col("property") == "dateModified", F.col("day"))).alias("modified")).where("published IS NOT NULL OR modified IS NOT NULL")


def made(pages: DataFrame) -> DataFrame:
    """Two blocks for each page, as the given ones have none: products, offers and dates by the page's number and URL, nested or named by ``@id``."""
    p = F.col("page_id")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    url = F.regexp_replace("url", r'["\\]', "")
    price = text('"price": "', p % 90 + 1, '.50", "priceCurrency": "EUR", "availability": "https://schema.org/', F.when(p % 2 == 0, "InStock").otherwise("OutOfStock"), '"')
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 300).cast("int")), "yyyy-MM-dd")
    offer = F.when(p % 4 == 0, text("{", price, "}")).when(p % 4 == 1, text('[{"@id": "', url, '#o"}, {"@type": "Offer", "priceSpecification": {"price": ', p % 50, ', "priceCurrency": "USD"}}]')).when(p % 4 == 2, text('{"@id": "#gone"}')).otherwise(text('{"@id": "', url, '#o"}'))
    one = text('{"@context": "https://schema.org", "@graph": [{"@type": "WebPage", "mainEntity": {"@type": ["Product", "Thing"], "name": "N', p, '", "offers": ', offer, '}, "datePublished": "', day, 'T10:00:00Z"}]}')
    two = text('[{"@id": "', url, '#o", "@type": "Offer", ', price, '}, {"@type": "Article", "hasPart": [{"isPartOf": {"dateModified": "', day, '", "datePublished": "soon"}}]}]')
    return pages.select("page_id", F.posexplode(F.array(one, two, F.lit("{broken"))).alias("block", "json"))


_DAY = "CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE)"
_STOCK = "CASE WHEN page_id % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END"


@query(
    "jsonld_offers",
    f"""WITH p AS (SELECT page_id, 'N' || page_id AS product, (page_id % 90 + 1) || '.50' AS price, {_STOCK} AS availability FROM pages)
    SELECT page_id, product, price, 'EUR' AS currency, availability FROM p WHERE page_id % 4 IN (0, 1, 3)
    UNION ALL SELECT page_id, product, CAST(page_id % 50 AS VARCHAR), 'USD', NULL FROM p WHERE page_id % 4 = 1
    UNION ALL SELECT page_id, product, NULL, NULL, NULL FROM p WHERE page_id % 4 = 2""",
)
def jsonld_offers(spark, sf_dir):
    """Offers of the products in every page's blocks, nested, in lists, or named in another block."""
    return offers(nodes(made(table(spark, sf_dir, "pages"))))


@query("jsonld_dates", f"SELECT page_id, {_DAY} AS published, {_DAY} AS modified FROM pages")
def jsonld_dates(spark, sf_dir):
    """When every page was published and changed, as its blocks say at any depth."""
    return dates(nodes(made(table(spark, sf_dir, "pages"))))


@query(
    "jsonld_items",
    """WITH k AS (SELECT page_id, page_id % 4 AS k FROM pages)
    SELECT type, sum(n)::BIGINT AS items, sum(CASE WHEN kept THEN n ELSE 0 END)::BIGINT AS own FROM (
      SELECT 'WebPage' AS type, 1 AS n, true AS kept FROM k UNION ALL SELECT 'Product', 1, true FROM k UNION ALL SELECT 'Thing', 1, true FROM k UNION ALL SELECT 'Article', 1, true FROM k
      UNION ALL SELECT 'Offer', CASE WHEN k = 1 THEN 2 ELSE 1 END, true FROM k
      UNION ALL SELECT '', 3, true FROM k UNION ALL SELECT '', 1, k <> 1 AND k <> 3 FROM k UNION ALL SELECT '', 1, true FROM k WHERE k = 1) GROUP BY type""",
)
def jsonld_items(spark, sf_dir):
    """Items by type over all pages, and how many of them stand for themselves (not for another that they name)."""
    each = items(nodes(made(table(spark, sf_dir, "pages"))))
    own = (F.col("target.block") == F.col("block")) & (F.col("target.path") == F.col("path"))
    return each.select(F.explode(F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit("")))).alias("type"), own.alias("own")).groupBy("type").agg(F.count("*").alias("items"), F.count_if("own").alias("own"))
