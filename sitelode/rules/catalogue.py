"""Per-page rules as data: code, severity, category, title and a condition on the page facts.

Conditions are plain SQL over the columns of ``sitelode.html.facts``; all rules compile to one projection.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    code: str
    severity: str
    category: str
    title: str
    when: str


# Codes, severities, titles and thresholds that results must agree on.
_SEO = """
META001 | error | Missing page title | title IS NULL
META002 | warning | Title too short | title_bytes < 30
META003 | warning | Title too long | title_bytes > 60
META004 | warning | Missing meta description | description IS NULL
META005 | warning | Meta description too short | description_bytes < 120 AND NOT utility_page
META006 | warning | Meta description too long | description_bytes > 165
META009 | warning | Missing viewport meta tag | viewport IS NULL
HEAD001 | warning | No headings found | heading_count = 0
HEAD002 | error | Missing H1 heading | h1_count = 0
HEAD003 | warning | Multiple H1 headings | h1_count > 1
HEAD004 | warning | Skipped heading level | skips_level
CANON001 | warning | Missing canonical URL | canonical IS NULL
TITLE001 | warning | Title too short | title_bytes < 30
TITLE002 | warning | Title too long | title_bytes > 60
TITLE-PX002 | info | Title too short for SERP display | title_bytes < 20
TITLEDEEP001 | warning | Title too short | title_bytes < 20
TITLEDEEP002 | warning | Title too long for SERP display | title_bytes > 65
TITLEDEEP003 | info | Title missing brand separator | title_bytes > 30 AND title NOT LIKE '%|%' AND title NOT LIKE '% - %'
TITLE-QLT001 | warning | Title too short for quality | title_bytes < 20
TITLE-QLT002 | info | Title may be truncated in search results | title_bytes > 60 AND title_bytes <= 70
TITLE-QLT003 | warning | Title too long for search results | title_bytes > 70
TITLE-QLT004 | info | Title appears to be a single word | title_bytes > 0 AND title NOT LIKE '% %'
TITLE-V3001 | warning | Title tag too short | title_bytes < 20
METADESC001 | warning | Meta description too short | description_bytes < 70
METADESC002 | warning | Meta description too long | description_bytes > 160
METADESC003 | warning | Meta description identical to title | description = title
METADESC-UNI001 | info | Meta description is very short | description_bytes < 10
METADEEP001 | warning | Meta description too short | description_bytes < 70
METADEEP002 | warning | Meta description too long | description_bytes > 160
METADEEP003 | info | Meta description contains quotes | description LIKE '%"%' OR description LIKE '%''%'
META-QLT001 | warning | Meta description too short for quality | description_bytes < 70
META-QLT002 | info | Meta description may be truncated | description_bytes > 160
META-PX001 | warning | Meta description too long for SERP display | description_bytes > 160
MDESC-PX002 | info | Meta description too short for SERP display | description_bytes < 70
META-V3001-LENGTH | warning | Meta description too long | description_bytes > 165
META-ROB001 | warning | Conflicting meta robots directives: index and noindex | robots_noindex AND robots_index
META-ROB002 | warning | Conflicting meta robots directives: follow and nofollow | robots_nofollow AND robots_follow
MRVAL001 | error | Conflicting noindex and index directives | robots_noindex AND robots_index
MRVAL002 | error | Conflicting nofollow and follow directives | robots_nofollow AND robots_follow
ROBOTS001 | warning | noindex on content page | robots_noindex AND NOT utility_page
ROBOTS002 | info | nofollow on content page | robots_nofollow AND NOT utility_page
LINK001 | info | Link counts | link_count >= 0
LINK-V2001 | warning | Too many external links | link_count > 0 AND 2 * external_links > link_count
INTLINKQ002 | warning | All internal links are nofollowed | nofollow_links > 0 AND nofollow_links = internal_links
INTLINKQ003 | warning | Internal links with empty anchor text | internal_links > 0 AND empty_links > 0
PIMP001 | info | Page has no links | word_count > 0 AND link_count = 0
PIMP002 | warning | Content page missing internal links | internal_links = 0 AND word_count > 200
PIMP003 | info | High number of external links | external_links > 20
IL-DEPTH001 | info | Deep internal page | url_depth > 4
URL002 | info | Uppercase characters in URL | path <> lower(path) AND path NOT LIKE '%\\%%'
SITEMAP-U001 | warning | URL contains query parameters | query <> ''
SITEMAP-U002 | info | URL contains uppercase characters | path <> lower(path)
CANCON001 | error | Empty canonical URL | canonical = ''
CANDEEP003 | warning | Canonical URL contains fragment | canonical LIKE '%#%'
CDEP002 | warning | Canonical URL contains query parameters | canonical LIKE '%?%'
AI-CIT001 | info | Missing canonical URL | canonical IS NULL
AI-CIT005 | warning | No structured data found | json_ld_count = 0
AI-CIT007 | warning | Missing OpenGraph tags | og_title IS NULL AND og_description IS NULL AND og_image IS NULL
SD001 | info | No structured data found | json_ld_count = 0
"""
_CONTENT = """
CQ003 | warning | No content detected | word_count = 0
CQ004 | warning | Thin content | word_count > 0 AND word_count < 300 AND NOT utility_page
CQ005 | info | Long-form content | word_count > 3000
THIN001 | warning | Thin content on non-utility page | word_count >= 100 AND word_count < 300 AND NOT utility_page
THIN002 | error | Extremely thin content | word_count < 100
CDEPTH001 | warning | Content missing headings | heading_count = 0 AND word_count > 100
CDEPTH002 | warning | Missing H1 heading | h1_count = 0 AND word_count > 50
CDEPTH003 | warning | Multiple H1 headings | h1_count > 1
CDEPTH004 | info | Low heading density | word_count > 50 AND heading_count > 0 AND word_count > 300 * heading_count
CONT-STR001 | warning | Long-form content without subheadings | word_count > 1500 AND heading_count <= 1
AI-CS002 | warning | Content lacks subheadings | word_count > 500 AND heading_count < 3
TOC001 | info | Long-form page missing table of contents | word_count > 2000 AND heading_count > 5
HCOV001 | warning | Heading hierarchy missing H1 | heading_count > 0 AND h1_count = 0
HCOV002 | warning | Heading level skipped | skips_level
WC001 | info | Word count statistics | word_count >= 0
WC002 | warning | Zero word count | word_count = 0
WC003 | warning | Very low word count | word_count > 0 AND word_count < 100 AND NOT utility_page
WC004 | info | Long average sentence length | sentence_count > 0 AND word_count > 25 * sentence_count
WC-V2001 | warning | Word count below 100 | word_count > 0 AND word_count < 100
CREAD003 | warning | Long average sentence length | sentence_count > 0 AND word_count > 25 * sentence_count
"""
_ACCESSIBILITY = """
A11Y001 | error | Images missing alt attribute | images_missing_alt > 0
A11Y002 | warning | No headings found | heading_count = 0
A11Y003 | error | Missing H1 heading | h1_count = 0
A11Y004 | warning | Multiple H1 headings | h1_count > 1
A11Y005 | warning | Skipped heading level | skips_level
A11Y006 | warning | Missing main landmark | NOT has_main
A11Y007 | info | No navigation landmark | NOT has_nav
A11Y008 | warning | Missing skip navigation link | NOT has_skip_link AND has_nav
A11Y009 | error | Empty link text | empty_links > 0
A11Y010 | warning | Non-descriptive link text | generic_links > 0
A11Y011 | error | Form input missing label | input_count > label_count
A11Y012 | error | Positive tabindex values detected | positive_tabindex > 0
A11Y014 | warning | Table missing header cells | table_count > 0 AND th_count = 0
A11Y016 | error | Missing html lang attribute | lang IS NULL
ARIALAND001 | warning | Missing main landmark | NOT has_main
ARIALAND002 | info | Missing navigation landmark | NOT has_nav AND link_count > 3
LAND001 | error | Missing main landmark region | NOT has_main
LAND002 | warning | Missing navigation landmark | NOT has_nav
LAND003 | info | Missing banner/header landmark | NOT has_header
LANDMAIN001 | error | Page missing main landmark | NOT has_main
LANDNAV001 | warning | Page missing navigation landmark | NOT has_nav
LANDBAN001 | info | Page missing banner/header landmark | NOT has_header
HHIERDEEP001 | warning | Heading hierarchy skip | skips_level
HHIERDEEP003 | warning | Multiple H1 headings | h1_count > 1
HORDER001 | warning | Heading level skip detected | skips_level
HEADSKIP001 | warning | Heading level skip detected | skips_level
LINKTQ001 | warning | Generic link text detected | generic_links > 0
LINKTQ002 | error | Links without accessible text | empty_links > 0
IMGALTDEEP001 | warning | Images missing alt text | images_missing_alt > 0
FOCUSDEEP001 | error | Positive tabindex detected | positive_tabindex > 0
TABPOS001 | error | Positive tabindex values disrupt focus order | positive_tabindex > 0
LANGATTRDEEP001 | warning | Missing html lang attribute | lang IS NULL
LANGATTRDEEP002 | info | Language code may be too specific | lang NOT LIKE '%-%' AND length(lang) > 2
LANG-V2001 | error | Missing lang attribute | lang IS NULL
LANG001 | warning | Missing html lang attribute | lang IS NULL
LANGACC001 | error | Missing html lang attribute | lang IS NULL
LANGACC002 | warning | Lang attribute value too short | length(lang) < 2
TACC001 | warning | Table missing header cells | table_count > 0 AND th_count = 0
SKIPLINK001 | warning | No skip navigation link | has_nav AND NOT has_skip_link
"""
_PERFORMANCE = """
RES001 | warning | Excessive total resource count | script_count + style_count + image_count > 100
RES002 | warning | Excessive JavaScript file count | external_scripts > 20
RES003 | warning | Excessive image count | image_count > 50
IMG003 | info | Lazy-loaded images | images_lazy > 0
IMG004 | info | Images missing dimensions | images_without_size > 0
IMGDIM001 | warning | Images missing width/height attributes | images_without_size > 0
IMG-LAZY001 | warning | Images without lazy loading | image_count - images_lazy > 3
SCRIPT001 | warning | Excessive script count | script_count > 20
STYLE001 | warning | Excessive stylesheet count | style_count > 10
"""
_SOCIAL = """
SOCIAL004 | warning | Missing Twitter Card type | twitter_card IS NULL
SOCIAL005 | warning | Invalid Twitter Card type | twitter_card NOT IN ('summary', 'summary_large_image', 'app', 'player')
SOCIAL006 | warning | Incomplete Open Graph tags | og_title IS NULL OR og_description IS NULL OR og_image IS NULL OR og_url IS NULL OR og_type IS NULL
SPREV001 | warning | OG title missing | og_title IS NULL
SPREV002 | warning | OG description missing | og_description IS NULL
TW001 | warning | Twitter card type missing | twitter_card IS NULL
"""
_MOBILE = """
MOB001 | error | Missing viewport meta tag | viewport IS NULL
MOB002 | warning | Viewport missing width directive | viewport NOT LIKE '%width%'
MOB003 | error | Viewport width is not device-width | viewport LIKE '%width=%' AND viewport NOT LIKE '%device-width%'
MOB004 | error | Zooming is disabled (user-scalable=no) | viewport LIKE '%user-scalable=no%'
MOBVIEW001 | warning | Viewport missing initial-scale | viewport NOT LIKE '%initial-scale%'
"""


def _rules(category: str, lines: str) -> list[Rule]:
    out = []
    for line in lines.strip().splitlines():
        code, severity, title, when = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(code, severity, category, title, when.replace("\\\\", "\\")))
    return out


RULES: list[Rule] = [
    *_rules("seo", _SEO),
    *_rules("content", _CONTENT),
    *_rules("accessibility", _ACCESSIBILITY),
    *_rules("performance", _PERFORMANCE),
    *_rules("social", _SOCIAL),
    *_rules("mobile", _MOBILE),
]

# Codes that measure rather than report a defect.
METRICS = "READ001 READ002 READ003 READ004 READ005 CQ001 CQ002 CQ005 KW001 KW002 KW004 ENTITY001 ENTITY002 ENTITY003 ENTITY004 ENTITY005 ENTITY006 A11YSC001 MOB-SCORE001 PERF-EST001 SEC012 SECSC001 SOCIAL008 LINK001 WC001 HTTP006 SSL000 IMG003 CSS-COVERAGE-PARTIAL".split()

# Substrings of URLs of pages that serve a function rather than content.
UTILITY = "/login /register /signup /signin /auth /admin /dashboard /settings /account /search /sitemap /robots.txt /wp-admin /wp-login.php /cgi-bin /_next /_nuxt /compare /wishlist /cart /checkout /forgot /contact /about".split()

# Score weights by code pattern; the pattern with most literal characters wins.
WEIGHTS = [
    ("SEC*", "security", 0.25),
    ("SSL*", "security", 0.20),
    ("CSP*", "security", 0.15),
    ("HSTS*", "security", 0.10),
    ("SRI*", "security", 0.10),
    ("A11Y*", "accessibility", 0.12),
    ("ARIA*", "accessibility", 0.08),
    ("FOCUS*", "accessibility", 0.08),
    ("LANG*", "accessibility", 0.05),
    ("CWV*", "performance", 0.15),
    ("PERF*", "performance", 0.12),
    ("TTFB*", "performance", 0.10),
    ("CACHE*", "performance", 0.08),
    ("MOB*", "best-practices", 0.10),
    ("CHARSET*", "best-practices", 0.05),
    ("METADESC*", "seo", 0.08),
    ("TITLE*", "seo", 0.10),
    ("META*", "seo", 0.05),
    ("HEAD*", "seo", 0.05),
    ("LINK*", "seo", 0.04),
    ("IMG*", "seo", 0.05),
    ("SEO*", "seo", 0.06),
    ("SITEMAP*", "seo", 0.05),
    ("ROBOTS*", "seo", 0.05),
    ("CAN*", "seo", 0.06),
    ("*", "seo", 0.02),
]
SEVERITIES = ["critical", "error", "warning", "info"]
