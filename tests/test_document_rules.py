import pytest

from sitelode import dom
from sitelode.rules import document

CLEAN = """<html lang=en><head><link rel=search href=/o.xml></head><body><header>h</header><nav><a href=/a>one</a><a href=/b>two</a></nav><main>m</main><aside>s</aside><footer>f</footer>{}</body></html>"""
HITS = {
    "": [],
    '<main>2</main>': ["ARIALAND-V2005", "LANDMAIN-V5002"],
    '<b tabindex=2>x</b><b tabindex=0>y</b>': ["TAB-V2001", "TABINDEX001", "FOCUS-V2001", "FOCUSTABPOS-V6119", "FOCUS-V2001-DEEP-DEEP", "FOCUS-V2001-DEEP-DEEP-DEEP"],
    '<b tabindex="-1">x</b>' * 4: ["FOCUSDEEP002"],
    '<b tabindex="-1">x</b>' * 3: [],
    '<div role=note>x</div>': ["ARIA-V2001", "ARIA001", "ARIAREQ001", "ARIALABEL001", "ARIAROLE001", "ARIAREQ-V2001"],
    '<div role=note aria-label=l>x</div><div role=note>y</div>': ["ARIA002"],
    '<div role=note aria-label=l>x</div>': [],
    '<div role=progressbar aria-label=l>x</div>': ["ARIAREQ-V2002"],
    '<div role=slider aria-label=l aria-valuenow=1 aria-valuemin=0>x</div>': ["ARIAREQ-V2003"],
    '<div role=slider aria-label=l aria-valuenow=1 aria-valuemin=0 aria-valuemax=3>x</div>': [],
    '<div role=combobox aria-label=l>x</div>': ["ARIAREQ-V2004"],
    '<div role=tab aria-label=l>x</div>': ["ARIAREQ-V2005"],
    '<dialog>x</dialog>': ["FOCTR001"],
    '<dialog aria-modal=true>x</dialog>': [],
    '<div itemscope>x</div>': ["MD001"],
    '<div itemscope><b itemprop=n>x</b></div>': [],
    '<p typeof=T>x</p>': ["RDFA001"],
    '<p vocab=v>x</p>': ["RDFA002"],
    '<p vocab=v typeof=T property=p>x</p><meta property="og:x" content=y>': [],
    '<script src="http://c/x.js"></script>': ["MIXCONT001", "MIXSCR001", "MIXSCRIPT-V5001", "MIXED001"],
    '<script src="//c/x.js"></script><img src="https://c/i.png">': [],
    '<img src="HTTP://c/i.png" alt=a>': ["MIXCONT002", "MIXIMG001", "MIXED001"],
    '<iframe src="http://c/f"></iframe>': ["MIXCONT004", "MIXIFRAME-V6068", "MIXED001"],
    '<form action="http://c/f"></form>': ["MIXFRM001", "MIXED002"],
    '<a href="https://o/"></a>': ["A11Y-LINK-V2001", "LINKTEXT001", "LNKACC001", "LINKTQ-V2002-V2", "LINKEEMPTY-V6114", "LINKTQ-V2001-DEEP", "LINKTQ-V2001-DEEP-DEEP", "LINKSC003", "EXTLINKAUTH002"],
    '<a href="https://o/"><img src=i alt=pic></a><a href="https://p/" aria-label=l></a>': [],
    '<a href="https://o/">Click <b>here</b></a>': ["ANCHGEN001", "LINKTEXT002", "LNKACC002", "LINKTQ-V2001", "ANCHGEN-V2001", "LINKGEN-V6113", "LINKTQ-V2002-DEEP", "ANCHGEN-V2001-DEEP"],
    '<a href="https://en.wikipedia.org/x" rel="nofollow x">w</a>': ["WIKI001", "WIKI-V2001", "WIKI-V2002"],
    '<a href="https://notwikipedia.org/x">w</a>': [],
    '<a href="#top">self</a>': ["INTLINKQ001"],
    "".join(f'<a href="https://o{k}/">n{k}</a>' for k in range(11)): ["EXTLINKAUTH001", "NOFOLLOW002"],
    "".join(f'<a href="/p{k}" rel=nofollow>n{k}</a>' for k in range(5)): ["LINKSC002", "NOFOLLOW001"],
}


def codes(spark, pages, url="https://h/p"):
    df = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {i: set() for i in range(len(pages))}
    for r in document.document_findings(document.document_facts(dom.trees(df))).collect():
        found[r.page_id].add(r.code)
    return found


def test_codes_hit_and_stay_away(spark):
    found = codes(spark, [CLEAN.format(x) for x in HITS])
    for k, (markup, want) in enumerate(HITS.items()):
        assert found[k] == set(want), markup


def test_nothing_there(spark):
    (found,) = codes(spark, [None]).values()
    assert {"ARIALAND-V2006", "ARIALAND-ROLE-MAIN", "LANDCOMP-V6125", "LANGATTR-V2001", "LINKSC001", "OPSEARCH001"} <= found
    assert "MIXCONT001" not in codes(spark, [CLEAN.format('<script src="http://c/x.js"></script>')], "http://h/p")[0]
    assert "LANG003" in codes(spark, ["<html lang=''>"])[0]


def test_codes_are_told_once():
    codes = [r[0] for r in document.rules()]
    assert len(codes) == len(set(codes)) and all(s in ("critical", "error", "warning", "info") for _, s, *_ in document.rules())


@pytest.mark.parametrize("names", [["same", "same"], ["a", "a", "a", "b"]])
def test_anchor_texts(spark, names):
    page = "".join(f'<a href="/{k}">{x}</a>' for k, x in enumerate(names))
    (found,) = codes(spark, [page]).values()
    assert ("ANCH-DIV001" in found) == (len(set(names)) == 1) and "ANCH-V2001" not in found
