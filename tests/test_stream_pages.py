import random
import re

import pytest
from pyspark.sql import functions as F

from sitelode import html
from sitelode.streaming import pages as S

PARTS = ["<p>text", '<a href="/1">one</a>', "<a href='/2'>t <b>w</b>o</a >", '<a name="x">no</a>', "<!-- <a href='/no'>n</a> -->", "<!--", "-->", "<script>var a = '<a href=\"/no\">x</a>'", "</script>", "<scripty>", "<style>", "</style >", "<svg><a href='/svg'>s</a></svg>", '<a href="/a>b">gt</a>', "<a", " href='/3'>", "</a>", "<", "<abbr>", "é 漢", '<a title="q" href="/1">again</a>', "<noscript>", "</noscript>", '<A HREF="/4"', ">up</A>", "</body>", "</html>"]


@pytest.mark.parametrize("seed", range(60))
def test_scanner_equals_the_whole_page(seed):
    rng = random.Random(seed)
    for _ in range(25):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        scanner, got, at = S.Scanner(), [], 0
        while at < len(page):
            n = rng.choice([1, 2, 3, 7, 20, 100])
            got += scanner.feed(page[at : at + n])
            at += n
        got += scanner.feed("", True)
        assert got == re.findall(html.ANCHOR, re.sub(html.NOISE, " ", page)), page
        assert scanner.tail == scanner.clean == ""


def test_scanner_keeps_little():
    scanner = S.Scanner()
    for i in range(2000):
        scanner.feed(f'<p>some text {i}</p><a href="/{i}">link</a><!-- note --><script>x</script>')
        assert len(scanner.tail) + len(scanner.clean) < 200


def run(spark, tmp_path, batches, **how):
    """Batches of chunk rows, one micro-batch each."""
    schema = "page_id long, url string, seq long, chunk string, last boolean, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.events(stream, **how).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.page_id, r.place, r.kind, r.anchor and re.search("/\\w+", r.anchor)[0]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_chunks_in_any_order(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    one = ['<a href="/x">1</a><a hr', 'ef="/y">2</a><a href="/x">3', "</a></bo", "dy></html>"]
    rows = [(1, "u", k, c, k == 3, at(k)) for k, c in enumerate(one)]
    late = (2, "v", 0, '<a href="/q">', False, at(1))
    got = run(spark, tmp_path, [[rows[2], rows[0], rows[0], late], [rows[3], (2, "v", 2, "never", False, at(2))], [rows[1], rows[1]], [rows[0], (3, "w", 0, None, True, at(5))], [(4, "z", 0, "", True, at(9000))], [(4, "z", 1, "after the end", False, at(9001))]])
    assert got == [(1, 0, "link", "/x"), (1, 1, "link", "/y"), (1, 2, "complete", None), (1, 2, "done", None), (2, 0, "expired", None), (3, 0, "done", None), (4, 0, "done", None)]


def test_a_page_that_a_batch_says_nothing_of_goes_on(spark, tmp_path):
    from datetime import datetime, timedelta

    row = lambda page, seq, chunk, last: (page, "u", seq, chunk, last, datetime(2024, 1, 1) + timedelta(seconds=seq))
    other = [row(2, k, f'<a href="/o{k}">o</a>', k == 3) for k in range(4)]
    got = run(spark, tmp_path, [[row(1, 0, '<a href="/a">a</a>', False), other[0]], [other[1]], [other[2]], [row(1, 1, '<a href="/b">b</a>', True), other[3]]])
    assert got == [(1, 0, "link", "/a"), (1, 1, "link", "/b"), (1, 2, "done", None), *[(2, k, "link", f"/o{k}") for k in range(4)], (2, 4, "done", None)]


def test_links_are_given_as_they_come_and_once(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "".join(f'<a href="/p{k % 4}">t{k}</a>' for k in range(i))) for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = S._streamed(spark, "test", {"chunks": S.chunked(df, 30).repartition(3, "seq")}, lambda chunks: S.links(S.events(chunks)), 1)
    got = sorted((r.page_id, r.place, r.target_url, r.anchor_text) for r in out.collect())
    assert got == [(i, k, f"http://h/p{k}", f"t{k}") for i in range(6) for k in range(min(i, 4))]


def test_chunks_spell_the_page(spark):
    df = spark.createDataFrame([(1, "u", "é" * 25), (2, "u", ""), (3, "u", None), (4, "u", "x" * 10)], "page_id long, url string, html string")
    rows = S.chunked(df, 10).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("h"), F.count("*").alias("n"), F.count_if("last").alias("l")).collect()
    assert {r.page_id: (r.h, r.n, r.l) for r in rows} == {1: ("é" * 25, 3, 1), 2: ("", 1, 1), 3: ("", 1, 1), 4: ("x" * 10, 1, 1)}


def test_two_crawls_as_streams_tell_what_tables_tell(spark, tmp_path):
    from sitelode import history

    url = lambda i: None if i % 29 == 1 else "end" if i == 40 else f"http://h/{i % 150}"
    pages = [(i, url(i), f"<html><head><title>t{i}</title></head><body>some words {i}</body></html>") for i in range(200)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = (sorted(map(str, q(spark, str(tmp_path)).select("url", "change").collect())) for q in (S.monitor_stream, history.crawl_diff))
    assert got == want


def test_a_long_page_does_not_make_others_late(spark, tmp_path):
    # 700 chunks: at a second each, they would let the watermark pass the first chunks of later batches
    pages = [(1, "http://h/1", "".join(f'<a href="/p{k}">{"t" * 380}</a>' for k in range(700))), (2, "http://h/2", "x" * 900 + '<a href="/q">q</a>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.place, r.target_url) for r in S.links_incremental(spark, str(tmp_path)).collect())
    assert got == [(1, k, f"http://h/p{k}") for k in range(700)] + [(2, 0, "http://h/q")]


class Kept:
    """State as Spark keeps it for one key: the value, the maps and timers, with a count of calls."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls = {}, None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getMapState(self, name, *schemas):
        kept, held = self, self.maps.setdefault(name, {})

        class Map:
            def __getattribute__(self, call):
                kept.calls += 1
                return {"updateValue": held.__setitem__, "containsKey": held.__contains__, "getValue": held.__getitem__, "removeKey": held.pop, "clear": held.clear}[call]

        return Map()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


@pytest.mark.parametrize("hold", [0, 60, 1 << 16])
def test_a_page_is_one_value_unless_it_holds_much(hold):
    from types import SimpleNamespace

    rng = random.Random(hold)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for _ in range(40):
        page = "".join(rng.choice(PARTS) for _ in range(30))
        cut = [page[i : i + 9] for i in range(0, len(page), 9)]
        rows = [SimpleNamespace(url="u", seq=k, chunk=c, last=k == len(cut) - 1) for k, c in enumerate(cut)] * 2
        rng.shuffle(rows)
        kept, pages, got = Kept(), S.Pages(hold=hold), []
        pages.init(kept)
        for i in range(0, len(rows), 10):
            got += pages.handleInputRows((1,), iter(rows[i : i + 10]), clock)
        seen = dict.fromkeys(re.match(html.HREF, a)[1].strip(" ") for a in re.findall(html.ANCHOR, re.sub(html.NOISE, " ", page)))
        assert [re.match(html.HREF, r.anchor)[1].strip(" ") for r in got if r.kind == "link"] == list(seen)
        assert [r.kind for r in got].count("done") == 1 and not kept.timers and not any(kept.maps.values())
        assert hold < 1 << 16 or kept.calls <= 2 * -(-len(rows) // 10) + 2
