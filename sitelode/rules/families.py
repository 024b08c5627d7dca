"""Defects that several rules report under titles of their own."""

from __future__ import annotations

# A defect and the codes that report it. Codes that are not here go by their titles.
FAMILIES = """
duplicate titles across pages: DUP-CROSS001 KEY-CANNIB001
meta description too short: MDESC-PX002 META005 METADEEP001 METADESC001
multiple h1 headings: A11Y004 CDEPTH003 HEAD003 HHIERDEEP003
missing h1 heading: A11Y003 CDEPTH002 HEAD002
missing x-content-type-options header: SEC005
missing main landmark: A11Y006 ARIALAND001 LAND001 LANDMAIN001
missing navigation landmark: A11Y007 ARIALAND002 LAND002 LANDNAV001
title too short: META002 TITLE001 TITLEDEEP001
hsts missing includesubdomains: HSTS001 SEC015
missing canonical url: AI-CIT001 CANON001
missing referrer-policy header: SEC007
too many external links: PIMP003 LINK-V2001
meta description too long: META-PX001 META-V3001-LENGTH META006 METADEEP002 METADESC002
missing html lang attribute: A11Y016 LANG001 LANGACC001 LANGATTRDEEP001
missing permissions-policy header: SEC008
no headings found: A11Y002 HEAD001
heading level skipped: A11Y005 HCOV002 HEAD004 HEADSKIP001 HORDER001
images missing alt attribute: A11Y001
missing banner landmark: LAND003 LANDBAN001
title too long: META003 TITLE002 TITLEDEEP002
csp script-src allows unsafe-inline: CSP001
empty link text: A11Y009
hsts missing preload: SEC016
hsts missing preload directive: HSTS002
images missing alt text: IMGALTDEEP001
images missing dimensions: IMG004 IMGDIM001
invalid x-content-type-options value: SEC006
invalid x-frame-options value: SEC004
missing meta description: META004
missing strict-transport-security header: SEC002
missing x-frame-options header: SEC003
empty canonical url: CANCON001
internal links with empty anchor text: INTLINKQ003
long average sentence length: CREAD003 WC004
meta description identical to title: METADESC003
missing lang attribute: LANG-V2001
missing skip navigation link: A11Y008 SKIPLINK001
missing twitter card type: SOCIAL004 TW001
missing viewport meta tag: META009 MOB001
no data found: AI-CIT005 SD001
no links on page: PIMP001
positive tabindex detected: FOCUSDEEP001
positive tabindex values detected: A11Y012
positive tabindex values disrupt focus order: TABPOS001
table missing header cells: A11Y014 TACC001
thin content: CQ004 THIN001
tables missing captions: A11Y015 TACC002
cookie missing httponly flag: COOKIE002 COOKIEHTTP001
cookie missing samesite attribute: COOKIESAME001
cookie missing secure flag: COOKIE001 COOKIESEC001
missing cross-origin-opener-policy: SEC010
missing cross-origin-embedder-policy: SEC009
missing cross-origin-resource-policy header: SEC011 CORP001
cors wildcard with credentials: CORS001
cors allows all origins: CORS002
referrer-policy set to unsafe-url: REF002
multiple canonical tags: CANCHAIN001
duplicate hreflang language: HREF003
missing hreflang x-default: HREF001
form input missing associated label: FILABEL001 FLABEL001
redirect loop detected: REDIR002 REDIRLOOP001
article missing author: ARTAUTH-V2001
article missing datepublished: ARTDT-V2001
recipe missing cooktime: RECIPE002 RECIPECOOK001
organization missing name: ORG-NAME001 ORG001
person missing name: PERS-NAME001 PERS001
"""


def families() -> dict[str, str]:
    """Defect by code."""
    out = {}
    for line in FAMILIES.strip().splitlines():
        defect, codes = line.split(": ")
        out |= dict.fromkeys(codes.split(), defect)
    return out
