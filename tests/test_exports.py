import csv
import glob
import io
import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitelode import findings, html
from sitelode.operators import exports as X
from sitelode.sources import layouts as L

PAGES = [
    (1, "http://h/b?x=1&y=2", '<html><head><title>A "quoted", title\nwith <lines></title><script type="application/ld+json">{"@type": "Article"}</script></head><body><h1>H</h1><a href="/c">l "q"</a></body></html>'),
    (2, "http://h/a", "<html><body><p>x</p></body></html>"),
    (3, "http://h/b?x=1&y=2", None),
]


@pytest.fixture(scope="module")
def crawl(spark):
    parsed = html.parse(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    found = findings.findings(html.facts(parsed)).where("NOT is_metric")
    extracted = spark.createDataFrame([(1, "r", ["v", 'w"']), (1, "q", [""])], "page_id long, rule_name string, values array<string>")
    return X.crawl_rows(parsed, X.fetched(parsed), found, extracted), found


def document(path):
    return "\n".join(open(f, encoding="utf-8").read().rstrip("\n") for f in sorted(glob.glob(f"{path}/part-*")))


def test_csv(crawl, tmp_path):
    rows, found = crawl
    X.write_csv(rows.coalesce(1), f"{tmp_path}/c")
    (name,) = glob.glob(f"{tmp_path}/c/part-*.csv")
    got = list(csv.DictReader(io.StringIO(open(name, encoding="utf-8").read())))
    assert list(got[0]) == X.CSV_COLUMNS and len(X.CSV_COLUMNS) == 22 and len(got) == 3
    one = next(r for r in got if r["title"].startswith("A"))
    assert one["title"] == 'A "quoted", title\nwith <lines>' and one["has_structured_data"] == "true" and one["schema_types"] == "Article"
    assert json.loads(one["extractions"]) == {"q": [""], "r": ["v", 'w"']}
    assert json.loads(one["links"]) == [{"url": "http://h/c", "text": 'l "q"', "is_external": False}]
    assert [len(json.loads(r["issues"])) for r in got] == [int(r["issue_count"]) for r in got]
    X.write_csv(rows.coalesce(1), f"{tmp_path}/d", ["issue_count", "url"])
    (name,) = glob.glob(f"{tmp_path}/d/part-*.csv")
    assert open(name, encoding="utf-8").readline().strip() == "url,issue_count"


def test_json_document(crawl, spark, tmp_path):
    rows, found = crawl
    X.write_document(X.json_document(rows, found, "c1", "http://h/"), f"{tmp_path}/j", ["part", "url", "page_id"])
    got = json.loads(document(f"{tmp_path}/j"))
    assert got["schema_version"] == "2.0" and got["crawl"] == {"id": "c1", "target_url": "http://h/", "pages_crawled": 3, "total_issues": found.count()}
    assert [p["page_id"] for p in got["pages"]] == [2, 1, 3]
    assert list(got["stats"]["issues_by_severity"]) == sorted(got["stats"]["issues_by_severity"]) and got["stats"]["total_pages"] == 3
    assert sum(len(p["issues"]) for p in got["pages"]) == found.count() == got["stats"]["total_issues"] == sum(got["stats"]["issues_by_category"].values())
    assert got["pages"][1]["title"] == 'A "quoted", title\nwith <lines>' and got["pages"][0]["title"] is None


def test_json_document_of_an_empty_crawl(crawl, tmp_path):
    rows, found = crawl
    X.write_document(X.json_document(rows.where("false"), found.where("false"), "c0", "u"), f"{tmp_path}/j", ["part", "url", "page_id"])
    got = json.loads(document(f"{tmp_path}/j"))
    assert got["pages"] == [] and got["stats"]["total_issues"] == 0 and got["stats"]["total_pages"] == 0


def test_html_report(crawl, tmp_path):
    rows, found = crawl
    X.write_document(X.html_report(rows, found, "http://h/?a&b"), f"{tmp_path}/h", ["part", "k", "url", "page_id"])
    text = document(f"{tmp_path}/h")

    class Rows(HTMLParser):
        cells, open, links = [], [], []

        def handle_starttag(self, tag, attrs):
            if tag not in ("meta",):
                self.open.append(tag)
            if tag == "tr":
                self.cells.append([])
            if tag in ("td", "th"):
                self.cells[-1].append("")
            self.links += [v for k, v in attrs if k == "href"]

        def handle_endtag(self, tag):
            assert self.open.pop() == tag

        def handle_data(self, data):
            if self.open and self.open[-1] in ("td", "th", "a", "span"):
                self.cells[-1][-1] += data

    p = Rows()
    p.feed(text)
    assert p.open == [] and text.startswith("<!DOCTYPE html>") and "http://h/?a&amp;b" in text
    head = p.cells.index(["URL", "Status", "Title", "Words", "Load", "Issues"])
    assert [c[0] for c in p.cells[head + 1 :]] == ["http://h/a", "http://h/b?x=1&y=2", "http://h/b?x=1&y=2"] == p.links
    assert p.cells[head + 2][2] == 'A "quoted", title\nwith <lines>' and p.cells[head + 1][2] == "—"
    assert 0 < head - 1 <= 20


def test_layout(spark, tmp_path):
    path = str(tmp_path)
    df = spark.range(25).select("id", F.concat(F.lit("t"), "id").alias("t")).repartition(3)
    L.write_table(df, path, "pages", "r1", 4)
    L.write_table(df.where("id < 3"), path, "pages", "r2")
    L.write_table(df.where("false"), path, "pages", "r3")
    assert sorted((r.id, r.run) for r in L.read_table(spark, path, "pages").collect()) == sorted([(i, "r1") for i in range(25)] + [(i, "r2") for i in range(3)])
    m = L.manifests(path, "pages")["r1"]
    assert m["rows"] == 25 and all(0 < f["rows"] <= 4 and f["bytes"] > 0 for f in m["files"]) and len(m["files"]) >= 7
    assert L.read_table(spark, path, "pages", ["r3"]).count() == 0
    L.write_table(df.where("id = 1"), path, "pages", "r1")  # replaced as a whole
    assert [r.id for r in L.read_table(spark, path, "pages", ["r1"]).collect()] == [1]
    with pytest.raises(ValueError):
        L.read_table(spark, path, "pages", ["r9"])
    with pytest.raises(ValueError):
        L.read_table(spark, path, "other")


def test_a_failed_job_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path)
    df = spark.range(100).repartition(4)
    L.write_table(df, path, "pages", "r1")
    bad = df.select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    for run in ("r1", "r2"):
        with pytest.raises(Exception, match="broken"):
            L.write_table(bad, path, "pages", run, 5)
    assert list(L.manifests(path, "pages")) == ["r1"] and L.read_table(spark, path, "pages").count() == 100
    # files of attempts that died without a word are there, and are not read
    import shutil

    (some,) = glob.glob(f"{path}/pages/run=r1/*")[:1]
    shutil.copy(some, some.replace("part-", "part-0"))
    assert L.read_table(spark, path, "pages").count() == 100
