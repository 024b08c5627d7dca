"""Rules on images, forms, tables, scripts and links in the head: a condition on element facts, and the codes that report it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import elements
from ..registry import query, texts
from .headers import SEVERITY, _lines

# Condition | severity, category, code and title of each rule that reports it.
RULES = """
images_no_alt > 0 | w images IMG001 Image missing alt text | e accessibility IMG-V2001 Images missing alt attribute | e accessibility IMGACC001 Image missing alt attribute | w accessibility IMGALT-V2001-DEEP-DEEP Images missing alt attribute | w accessibility IMGALTMISS-V6116 Images missing alt text
images_no_alt + images_empty_alt > 0 | w images IMGALT001 Image missing alt text | w images IMGALT-V2001 Images missing alt
images_empty_shown > 0 | w accessibility IMGACC002 Image with empty alt on non-decorative image
images_empty_alt > 0 | i images IMGALTEMPTY-V6117 Empty alt attributes | i images IMGALT-V2002-DEEP-DEEP Images with empty alt text
images_long_alt > 0 | i images IMGALTDEEP002 Alt text too long
images_generic_alt > 0 | w images IMGALT-V2003 Generic alt text
images_generic_alt > 2 | i images IMGDECPAT-V6118 Suspiciously generic alt text
images_inline > 0 | w performance IMGFS001 Inline data URI image
images_no_size > 0 | i images IMGDIM-V5001 Images missing dimensions
images > 3 AND images_lazy = 0 | i performance IMGLAZY-V5001 No lazy loading on images
images > 3 AND images_modern = 0 | i performance IMGFMT-V5001 No modern image formats
tables > 0 AND tables_headed = 0 | w accessibility TBL-V2001 Tables without headers | w accessibility TABACC-V2001 Tables without headers | w accessibility TBLHDR-V5001 All tables missing headers | w accessibility TABSCOPE-V6111 Tables missing header scope | w accessibility TBLSCOP-V2001 Tables without proper headers
tables_headed < tables | w accessibility TABACCDEEP001 Tables without headers
tables_headed > 0 AND tables_headed < tables | i accessibility TBLHDR-V5002 Some tables missing headers
tables > 0 AND tables_captioned = 0 | i accessibility TABACC-V2002 Tables without captions | i accessibility TBLCAPT-V5001 Tables missing captions | i accessibility TABCAP-V6112 Tables missing captions | w accessibility TBLCAP-V2001 No table captions
tables_captioned < tables | i accessibility TBLCAP001 Tables missing caption element | i accessibility TACC002 Table missing caption | i accessibility TABLECAP001 Table missing caption element | i accessibility A11Y015 Table missing caption
tables > 1 AND tables_captioned < tables | i accessibility TABACCDEEP002 Tables missing captions
forms_no_action > 0 | w forms FORM001 Form missing action URL
inputs_unlabeled > 0 | e forms FLABEL001 Form input missing associated label | e forms FORMLAB001 Form inputs missing label associations
inputs_bare > 0 | w forms FORMLBL-V2001 Form elements without labels | w forms FORMLBLASSOC-V5001 Form inputs without labels | w forms FORMLBL-V2001-DEEP-DEEP Form inputs without labels
inputs_required_bare > 0 | w forms FORMREQ-V5001 Required fields missing labels | w forms FORMREQ-V6110 Required fields missing labels
inputs_distinct_ids < inputs_ids | w forms FORMLAB-V2001 Duplicate input IDs
forms_many_bare > 0 | i forms FORMFSLG-V6123 Complex forms without fieldset
forms > 0 AND aria_labels = 0 | i accessibility FORMLBLDEEP001 Forms present but no ARIA labels
forms > 3 AND aria_labels < forms | w accessibility FORMLBLDEEP002 Insufficient ARIA labels for forms
scripts_blocking > 3 | w performance SCRIPT002 Multiple blocking scripts
scripts_blocking > 0 | c performance SCRIPT-V2001 Scripts without async/defer | w performance SCRIPTBLK-V5001 Blocking scripts detected
scripts_unsigned > 0 | w security SRI001 External scripts missing integrity attribute
sheets_unsigned > 0 | w security SRI002 External stylesheets missing integrity attribute
scripts_external > 0 AND scripts_unsigned = scripts_external | w security SRI-V5001 No SRI on external scripts
langs = 0 | i seo HREFMISS-V6092 No hreflang tags
langs > 0 AND langs_default = 0 | w seo HREF001 Missing x-default hreflang | w seo HREF-V3001 Hreflang missing x-default | w seo HREF-V4001 Missing x-default | w seo HREFXD-V5001 Missing x-default hreflang | i seo HREFXD-V6094 Missing hreflang x-default | i seo HREFXD001 Missing hreflang x-default | w seo ISEO002 Missing x-default in enhanced hreflang
langs > 2 AND langs_default = 0 | w seo HREFNET002 Missing x-default in hreflang network
langs_bad > 0 | e seo HREF002 Invalid hreflang locale code
langs > 1 AND langs_distinct < langs | e seo HREF003 Duplicate hreflang language | e seo HREFR002 Duplicate hreflang language codes | w seo HREFNET001 Duplicate hreflang language | w seo HREF-V4003 Duplicate hreflang entries | w seo HREFRECIP-V6093 Duplicate hreflang languages
langs > 0 AND langs_self = 0 | w seo HREFSELF001 Missing self-referencing hreflang | w seo HREFSELF-V2001 Missing hreflang self-reference | w seo HREFRECIP-V5001 Missing self-referencing hreflang
canonicals > 1 | w seo CANCHAIN001 Multiple canonical tags | w seo CANCHAIN-V2001 Multiple canonical tags | w seo CANCHAIN-V6090 Multiple canonical tags
canonical IS NULL | w seo CANMISS-V6088 Missing canonical URL | w seo CANMISS-V2001 Missing canonical URL | w seo CAN-V3001 Missing canonical URL
canonical <> url | w seo CAN-V2001 Canonical URL mismatch | w seo SITEMAP006 Non-canonical page with canonical tag
canonical LIKE '%#%' | w seo CANDEEP-V2005 Canonical contains fragment | w seo CAN-V3005 Canonical has fragment
canonical LIKE '%?%' | i seo CANDEEP-V2006 Canonical has query params
title IS NULL | c seo TITLEMISS-V6081 Missing title tag | c seo TITLEMISS001 Missing title tag | e seo TITLE-V4001 Missing title tag | e seo TITLELEN-V5001 Missing title tag
octet_length(title) < 20 | w seo TITLE-V4002 Title too short | w seo TITLEDEEP-V2001 Title critically short | w seo TITLEQLT-V2001 Title too short | i seo TITLELEN-V2002 Title too short
octet_length(title) < 30 | w seo TITLELEN-V5002 Title too short
octet_length(title) > 60 | w seo TITLEQLT-V2002 Title may truncate | w seo TITLELEN-V5003 Title may truncate | i seo TITLELEN-V2001 Title too long
octet_length(title) > 65 | w seo TITLE-V4003 Title may truncate
octet_length(title) > 70 | w seo TITLEDEEP-V2002 Title excessively long
upper(title) = title | w seo TITLE-V4004 ALL CAPS title
description IS NULL | w seo METADESCMISS-V6085 Missing meta description | w seo METADESCMISS001 Missing meta description | w seo META-V3001 Missing meta description
octet_length(description) < 70 | i seo METADESSSHORT-V6086 Meta description too short | i seo METADESSSHORT001 Meta description too short | w seo METADEEP-V2001 Description too short | i seo METALEN-V2002 Meta description too short
octet_length(description) < 50 | w seo METAQLT-V2001 Description too short
octet_length(description) > 155 | w seo METAQLT-V2002 Description may truncate
octet_length(description) > 160 | w seo METADEEP-V2002 Description too long | i seo METALEN-V2001 Meta description too long
description = title | w seo METADESCUNIQ-V6087 Meta description matches title | w seo METAUNIQ-V5001 Description identical to title
og_video <> '' | w social OGVID001 og:video present but missing og:video:url
og_site = '' | i social OGSITE002 Missing og:site_name
twitter_site = '' | w social TWSITE001 Missing twitter:site tag
twitter_site <> '' AND twitter_site NOT LIKE '@%' | w social TWSITE002 twitter:site does not start with @
"""


def rules() -> list[tuple[str, str, str, str, str]]:
    """Code, severity, category, title, condition."""
    return [(code, SEVERITY[s], category, title, when) for when, reports in _lines(RULES) for s, category, code, title in (r.split(" ", 3) for r in reports)]


def element_findings(facts: DataFrame) -> DataFrame:
    """page_id, url, code, severity, category, title of each rule that a page's elements break."""
    made = ", ".join(f"CASE WHEN {when} THEN named_struct('code', '{code}', 'severity', '{severity}', 'category', '{category}', 'title', '{title}') END" for code, severity, category, title, when in rules())
    return facts.select("page_id", "url", F.inline(F.expr(f"filter(array({made}), x -> x IS NOT NULL)")))


_made = ", ".join(f"CASE WHEN {when.replace('octet_length(', 'strlen(')} THEN {{'code': '{code}', 'severity': '{severity}', 'category': '{category}', 'title': '{title}'}} END" for code, severity, category, title, when in rules())


@query("element_rules", f"WITH {elements.SQL} SELECT page_id, url, unnest(list_filter([{_made}], lambda x: x IS NOT NULL), max_depth := 2) FROM ef")
def element_rules(spark, sf_dir):
    """Findings on the elements of every page, with what ``enriched`` adds."""
    return element_findings(elements.element_facts(elements.enriched(texts(spark, sf_dir, "pages"))))
