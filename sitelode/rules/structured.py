"""Rules on JSON-LD blocks, as data joined to what pages carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, table

# Code, severity (e, w, i), type of the block, property it must have.
REQUIRED = """
ORG001 e Organization name
ORG002 w Organization url
ORG003 w Organization logo
ORG-NAME001 w Organization name
ORGCONT-V5001 i Organization contactPoint
PERS001 e Person name
PERS002 i Person sameAs
PERS-NAME001 w Person name
PJOB001 i Person jobTitle
PJOB002 i Person worksFor
PERSURL-V5001 i Person url
JOB001 e JobPosting title
JOB002 e JobPosting datePosted
JOB003 w JobPosting validThrough
JSAL001 i JobPosting baseSalary
JSAL002 w JobPosting employmentType
JOBVALID001 w JobPosting validThrough
COURSE001 e Course name
COURSE002 w Course provider
COURSEPRE001 i Course prerequisite
RECIPE001 e Recipe name
RECIPE002 w Recipe cookTime
RECIPE003 w Recipe recipeIngredient
RECIPECOOK001 i Recipe cookTime
RECIPECOOK002 i Recipe prepTime
RECIPECOOK003 i Recipe totalTime
RNUT001 i Recipe nutrition
ACTION001 w Action actionType
AGGOFFER001 e AggregateOffer lowPrice
AGGOFFER002 e AggregateOffer priceCurrency
OFFER001 e Offer price
OFFER002 e Offer priceCurrency
OFFER003 w Offer availability
APT001 w Apartment name
APT002 i Apartment numberOfRooms
BOOK001 w Book isbn
BOOKAUTH-V6024 i Book author
BRAND001 w Brand name
BRAND002 i Brand url
BROADCAST001 w BroadcastEvent name
BROADCAST002 w BroadcastEvent startDate
CAR001 w Car name
CAR002 w Car model
CAR003 w Car manufacturer
CIVIC001 w CivicStructure name
CIVIC002 w CivicStructure address
COUP001 w Coupon validFrom
CREATIVE001 w CreativeWork name
CREATIVE002 i CreativeWork author
CREATIVE003 i CreativeWork datePublished
DATA001 e Dataset name
DATA002 w Dataset distribution
DSLICENSE-V5001 i Dataset license
EDUORG001 w EducationalOrganization name
EDUORG002 w EducationalOrganization address
EDUORG003 i EducationalOrganization url
EVENT001 e Event startDate
EVENT002 w Event location
EVENT003 i Event organizer
EVTPERF-V5001 i Event performer
FOOD001 w FoodEstablishment name
FOOD002 w FoodEstablishment address
FOOD003 i FoodEstablishment servesCuisine
GOV001 w GovernmentService name
GOV002 w GovernmentService provider
HP001 w HealthPlan name
HP002 w HealthPlan provider
HOWTO001 e HowTo name
INV001 w Invoice accountId
INV002 w Invoice dueDate
LANDFORM001 w Landform name
LANDFORM002 i Landform geo
LODGE001 w LodgingBusiness name
LODGE002 w LodgingBusiness address
LODGE003 i LodgingBusiness telephone
LBSTAR-V6007 i LodgingBusiness starRating
MOVIE001 w Movie name
MOVIE002 w Movie director
MOVIE003 i Movie dateCreated
MUSALB001 w MusicAlbum name
MUSALB002 w MusicAlbum byArtist
MUSREC001 w MusicRecording name
MUSART-V6032 i MusicRecording byArtist
NGO001 w NGO name
NGO002 i NGO address
NGO003 i NGO url
OCCUP001 w Occupation name
PERMIT001 w Permit permitNumber
PERMIT002 w Permit issuedBy
PLAN001 w Plan name
PLAN002 i Plan description
PLAYLIST001 w Playlist name
PLAYLIST003 i Playlist numTracks
PMODEL001 w ProductModel name
PMODEL002 w ProductModel brand
PRODBRAND-V6021 w Product brand
PRODREV-V6023 i Product review
RPROJ001 w ResearchProject name
RPROJ002 i ResearchProject about
SCHED001 w Schedule name
SCHED002 w Schedule scheduleTimezone
SVC001 w Service name
SVC002 w Service provider
SOFT001 w SoftwareApplication operatingSystem
SOFT002 w SoftwareApplication offers
SPEC001 e SpecialAnnouncement datePosted
SPEC002 w SpecialAnnouncement category
SPORTSEVT001 w SportsEvent name
SPORTSEVT002 w SportsEvent startDate
SPORTSEVT003 i SportsEvent location
TOURIST001 w TouristAttraction name
TOURIST002 w TouristAttraction address
TRIP001 w Trip name
TRIP002 w Trip itinerary
TVEP001 w TVEpisode episodeNumber
TV001 w TVSeries name
TV002 i TVSeries numberOfEpisodes
VID001 e VideoObject embedUrl
VID002 w VideoObject thumbnailUrl
VID003 i VideoObject duration
WAPI001 w WebAPI name
WAPI002 i WebAPI documentation
WEBPG001 w WebPage name
WEBPG002 i WebPage datePublished
WSITE001 w WebSite name
WSITE002 w WebSite url
WORKER001 w Worker name
WORKER002 w Worker jobTitle
ARTDT-V2001 i Article datePublished
ARTAUTH-V2001 i Article author
"""
_SEVERITY = {"e": "error", "w": "warning", "i": "info"}


def required() -> list[tuple[str, str, str, str]]:
    return [(c, _SEVERITY[s], t, p) for c, s, t, p in (line.split() for line in REQUIRED.strip().splitlines())]


def blocks(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, json_ld: array of texts): one row for each node, those of @graph taken apart; invalid JSON goes."""
    each = pages.select("page_id", F.posexplode("json_ld").alias("block", "json")).where(F.try_parse_json("json").isNotNull())
    inner = F.from_json(F.get_json_object("json", "$['@graph']"), "array<string>")
    return each.select("page_id", "block", F.explode(F.coalesce(inner, F.array("json"))).alias("node")).select("page_id", "block", "node", F.get_json_object("node", "$['@type']").alias("type"))


def structured_findings(pages: DataFrame) -> DataFrame:
    """page_id, block, code, severity, type, property for each required property that a block lacks or has empty."""
    rules = pages.sparkSession.createDataFrame(required(), "code string, severity string, type string, property string")
    met = blocks(pages).join(F.broadcast(rules), "type")
    value = F.expr("get_json_object(node, concat('$.', property))")
    return met.where(F.coalesce(F.trim(value), F.lit("")) == "").select("page_id", "block", "code", "severity", "type", "property")


#: Blocks that pages get in turn by their number.
BLOCKS = [
    ['{"@type": "Organization", "name": "A", "url": ""}', "{broken"],
    ['{"@graph": [{"@type": "Person", "name": "P", "sameAs": "x", "jobTitle": "j", "worksFor": {"a": 1}, "url": "u"}, {"@type": "Offer", "price": 3}]}'],
    ['{"@type": "Unknown"}'],
]


@query(
    "sd_rules",
    """SELECT page_id, 0 AS block, code, severity, type, property FROM pages JOIN (VALUES (0, 'ORG002', 'warning', 'Organization', 'url'), (0, 'ORG003', 'warning', 'Organization', 'logo'), (0, 'ORGCONT-V5001', 'info', 'Organization', 'contactPoint'),
    (1, 'OFFER002', 'error', 'Offer', 'priceCurrency'), (1, 'OFFER003', 'warning', 'Offer', 'availability')) t(k, code, severity, type, property) ON page_id % 3 = k""",
)
def sd_rules(spark, sf_dir):
    """Required properties that blocks lack or have empty, in a list, in a graph, broken or of an unknown type."""
    some = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in BLOCKS]), (F.col("page_id") % 3 + 1).cast("int"))
    return structured_findings(table(spark, sf_dir, "pages").select("page_id", some.alias("json_ld")))


def _quoted(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_KINDS = sorted({t for _, _, t, _ in required()})


def made_blocks(pages: DataFrame) -> DataFrame:
    """A JSON-LD block for each page, of the types in turn, with a name or a URL or neither (the given pages have none of their own)."""
    p = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (p % len(_KINDS) + 1).cast("int"))
    block = F.to_json(F.struct(kind.alias("@type"), F.when(p % 2 == 0, "N").alias("name"), F.when(p % 3 == 0, "https://h.example").alias("url")))
    return pages.select("page_id", F.array(block, F.lit("{broken")).alias("json_ld"))


@query(
    "sd_pages",
    f"WITH req(code, severity, type, property) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{s}{chr(39)}, {chr(39)}{t}{chr(39)}, {chr(39)}{p}{chr(39)})' for c, s, t, p in required())}), b AS (SELECT page_id, [{_quoted(_KINDS)}][page_id % {len(_KINDS)} + 1] AS type FROM pages) SELECT page_id, 0 AS block, code, severity, type, property FROM b JOIN req USING (type) WHERE NOT (property = 'name' AND page_id % 2 = 0) AND NOT (property = 'url' AND page_id % 3 = 0)",
)
def sd_pages(spark, sf_dir):
    """Required properties that the pages' blocks lack."""
    return structured_findings(made_blocks(table(spark, sf_dir, "pages")))
