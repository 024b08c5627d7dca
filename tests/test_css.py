import pytest
from pyspark.sql import functions as F

from sitelode import css, dom


def colors(spark, page):
    df = dom.trees(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    return {r.text: (r.color, r.background, round(r.pixels, 2), r.bold, None if r.ratio is None else round(r.ratio, 2), r.enough, r.linked) for r in css.text_colors(df).collect()}


def test_cascade(spark):
    page = """<style>
      p { color: red } .a { color: blue } #i { color: green } p.a { color: navy } div p { color: teal }
      /* p { color: white } */ b { color: inherit; font-weight: normal } em { color: lime !important; color: red }
      @media print { p { color: white } } @media (min-width: 1px) { u { color: maroon } }
      @keyframes k { from { color: white } to { color: black } } @import url(x.css);
      section > p { color: purple } section p i { color: olive } a:hover, p ~ s { color: white } h2 { font-size: 150% } .x, .y { color: #abc }
    </style>
    <p>type</p><p class=a>both</p><p class=a id=i>id</p><div><p>descendant</p><p class="c a">class</p></div>
    <p class=a>x<b>inherits</b><em style="color: white">important</em></p><u>media</u><p style="color:#123">inline</p>
    <section><p>child<i>deep</i></p><div><p>no child</p></div></section><s>plain</s><h2>large</h2><q class=y>list</q>"""
    got = {k: v[0] for k, v in colors(spark, page).items()}
    assert got == {
        "type": "red", "both": "navy", "id": "green", "descendant": "teal", "class": "navy", "x": "navy", "inherits": "navy", "important": "lime",
        "media": "maroon", "inline": "#123", "child": "purple", "deep": "olive", "no child": "teal", "plain": "#000000", "large": "#000000", "list": "#abc",
    }


def test_important_beats_inline_and_later_beats_earlier(spark):
    page = "<style>p{color:red!important}p{color:blue}.z{color:gray}.z{color:navy}</style><p style='color:white'>a</p><i class=z>b</i><i class=z style='color:teal;color:lime'>c</i>"
    assert {k: v[0] for k, v in colors(spark, page).items()} == {"a": "red", "b": "navy", "c": "lime"}


def test_backgrounds_sizes_and_ratios(spark):
    page = """<style>body{background:#eee;font-size:20px} .dark{background-color:#000;color:#777} .clear{background:transparent} .pic{background:url(a.png) #fff}
    .half{font-size:.5em} .pt{font-size:12pt} .none{background:none} .alpha{color:rgba(0,0,0,.5)} .rgb{color:rgb(100%, 0, 50%)}</style>
    <p>a</p><div class=dark><p class=clear>b</p><p class=none>b2</p><h1>c</h1><h3 class=half>d</h3></div><div class=pic>e <i style="background:white">f</i></div><p class=pt>g</p><p class=alpha>h</p><p class=rgb>i</p><a href=x>j</a><a>k</a><div class=half><div class=half>l</div></div>"""
    got = colors(spark, page)
    assert got["a"] == ("#000000", "#eee", 20.0, False, 18.1, True, False)
    assert got["b"] == ("#777", "#000", 20.0, False, 4.69, True, False) and got["b2"][1] == "#000"
    assert got["c"][2:4] == (40.0, True) and got["d"][2:4] == (10.0, True) and got["l"][2] == 5.0 and got["g"][2] == 16.0
    assert got["e"][4:6] == (None, None) and got["f"][4] == 21.0 and got["h"][4] is None
    assert got["i"][0] == "rgb(100%, 0, 50%)" and got["i"][4] is not None
    assert got["j"][0] == "#0000ee" and got["j"][6] and got["k"][0] == "#000000" and got["k"][6]


def test_large_texts_need_less(spark):
    page = "<style>body{color:#888}</style><p>a</p><p style='font-size:24px'>b</p><p style='font-size:19px'>c</p><b style='font-size:19px'>d</b>"
    assert {k: v[5] for k, v in colors(spark, page).items()} == {"a": False, "b": True, "c": False, "d": True}


def test_findings(spark):
    pages = [(1, "u", "<p style='color:#ccc'>a <a href=x style='color:#fff'>b</a> c</p><script>var x</script><title>t</title>"), (2, "u", "<p>fine</p>"), (3, "u", None), (3, "u", "")]
    df = dom.trees(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(tuple(r) for r in css.contrast_findings(df).select("page_id", "code", "texts", "worst").collect()) == [(1, "COLRCL001", 1, 1.0), (1, "COLRCT001", 2, 1.61)]


@pytest.mark.parametrize("value,want", [("#abc", [170, 187, 204]), ("#a1b2c3", [161, 178, 195]), ("white", [255, 255, 255]), ("rgb(1, 2,3)", [1, 2, 3]), ("rgba(1,2,3,1)", [1, 2, 3]), ("rgba(1,2,3,.4)", None), ("#abcd", None), ("var(--x)", None), ("rgb(300,0,0)", [255, 0, 0]), ("", None)])
def test_colour_values(spark, value, want):
    assert spark.range(1).select(css.channels(F.lit(value)).alias("c")).first().c == want
