"""Pages that arrive in pieces, and crawls watched against each other, as streams.

``links_as_they_come`` holds for each page what no link can be told from yet: the end of the text, chunks that
came before their turn, and the links already given. ``changes`` joins two crawls as streams.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import history, html
from ..functions import urls
from ..plans.scratch import shared_folder
from ..registry import query, texts

_OPENERS = re.compile(r"(?is)<!--|<(?:script|style|noscript|svg)\b")
_NOISE = re.compile(html.NOISE)
_ANCHOR = re.compile(html.ANCHOR)
_HREF = re.compile(html.HREF)
_LINK = re.compile(r"(?is)<a\b")
_PENDING_HREF = re.compile(r"(?is)\bhref\s*=\s*[\"'][^\"']*$")
#: Characters that a tag may need to be told from others: the longest of _OPENERS and what follows it.
_UNSURE = 12


class Scanner:
    """Finds a page's links while its text comes, keeping only what later text can still change.

    ``tail`` is text that may be the start of a comment, script, style and the like; ``clean`` text from
    which those are gone and that may be the start of a link. The same matches as over the whole page.
    """

    def __init__(self, tail: str = "", clean: str = "") -> None:
        self.tail, self.clean = tail, clean

    def feed(self, chunk: str, last: bool = False) -> list[str]:
        self.tail += chunk
        if last:
            self.clean += _NOISE.sub(" ", self.tail)
            self.tail = ""
        else:
            self._purify()
        return self._links(last)

    def _purify(self) -> None:
        while True:
            opened = _OPENERS.search(self.tail)
            if not opened:
                lt = self.tail.rfind("<")
                keep = lt if lt >= 0 and len(self.tail) - lt < _UNSURE else len(self.tail)
                self.clean, self.tail = self.clean + self.tail[:keep], self.tail[keep:]
                return
            # an opener at the very end may still be another word
            if opened.end() == len(self.tail) and not opened[0].endswith("-"):
                closed = None
            else:
                closed = _NOISE.match(self.tail, opened.start())
            self.clean += self.tail[: opened.start()]
            if not closed:
                self.tail = self.tail[opened.start() :]
                return
            self.clean += " "
            self.tail = self.tail[closed.end() :]

    def _links(self, last: bool) -> list[str]:
        out, at = [], 0
        while True:
            start = _LINK.search(self.clean, at)
            if not start:
                lt = self.clean.rfind("<", at)
                at = lt if lt >= 0 and len(self.clean) - lt < 4 else len(self.clean)
                break
            found = _ANCHOR.match(self.clean, start.start())
            if found:
                out.append(found[0])
                at = found.end()
                continue
            gt = self.clean.find(">", start.start())
            head = self.clean[start.start() : gt + 1]
            if gt < 0 or _HREF.match(head) or _PENDING_HREF.search(head) or (start.end() == len(self.clean)):
                at = start.start()  # its end is still to come
                break
            at = gt + 1  # an anchor without href
        self.clean = "" if last else self.clean[at:]
        return out


_OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("place", T.LongType()), T.StructField("anchor", T.StringType())])
_TEXT = T.StructType([T.StructField("tail", T.StringType()), T.StructField("clean", T.StringType()), T.StructField("next", T.LongType()), T.StructField("links", T.LongType()), T.StructField("complete", T.BooleanType()), T.StructField("url", T.StringType()), T.StructField("ends", T.StringType())])
_HELD = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("chunk", T.StringType()), T.StructField("last", T.BooleanType())]))
_PAGE = T.StructType([*_TEXT.fields, T.StructField("due", T.LongType()), T.StructField("timer", T.LongType()), T.StructField("held", _HELD), T.StructField("hrefs", T.ArrayType(T.StringType())), T.StructField("spilled", T.BooleanType())])
#: Characters of chunks before their turn, and of addresses already given, that a page's one value may hold; more go to maps.
_HOLD = 64 << 10
_SEQ = T.StructType([T.StructField("seq", T.LongType())])
_CHUNK = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("last", T.BooleanType())])
_KEY = T.StructType([T.StructField("href", T.StringType())])
_SEEN = T.StructType([T.StructField("place", T.LongType())])


class Pages(StatefulProcessor):
    """Chunks (page_id, url, seq from 0, chunk, last, ts) of pages in any order to events.

    link: an anchor whose address the page had not linked before, with its place among those. complete: the text so
    far holds an end of body or html. done: the last chunk has been read. expired: no chunk came within ``patience`` ms
    of event time, so the page was read as far as it had come. A chunk that comes twice, or after the end, is ignored.
    """

    def __init__(self, patience: int = 600_000, hold: int = _HOLD) -> None:
        self.patience, self.hold = patience, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a call for each piece of state costs more than the work on it, so a page is one value unless it holds much
        self.page = handle.getValueState("page", _PAGE)
        self.early = handle.getMapState("early", _SEQ, _CHUNK)
        self.seen = handle.getMapState("seen", _KEY, _SEEN)

    def _state(self) -> dict:
        old = self.page.get()
        if old is None:
            return {"tail": "", "clean": "", "next": 0, "links": 0, "complete": False, "url": None, "ends": "", "due": 0, "timer": 0, "held": {}, "hrefs": set(), "spilled": False}
        state = dict(zip(_PAGE.names, old))
        return state | {"held": {seq: (chunk, last) for seq, chunk, last in state["held"]}, "hrefs": set(state["hrefs"])}

    def _remember(self, state: dict) -> None:
        if sum(len(c) for c, _ in state["held"].values()) + sum(map(len, state["hrefs"])) > self.hold:
            for seq, chunk in state["held"].items():
                self.early.updateValue((seq,), chunk)
            for href in state["hrefs"]:
                self.seen.updateValue((href,), (0,))
            state |= {"held": {}, "hrefs": set(), "spilled": True}
        state = state | {"held": [(seq, chunk, last) for seq, (chunk, last) in state["held"].items()], "hrefs": list(state["hrefs"])}
        self.page.update(tuple(state[k] for k in _PAGE.names))

    def _taken(self, state: dict) -> tuple[str, bool] | None:
        """The chunk whose turn it is, if it is there."""
        key = (state["next"],)
        found = state["held"].pop(state["next"], None)
        if state["spilled"] and self.early.containsKey(key):
            found = found or self.early.getValue(key)
            self.early.removeKey(key)
        return found

    def _read(self, key: int, state: dict, chunk: str, last: bool) -> Iterator[Row]:
        scanner = Scanner(state["tail"], state["clean"])
        complete = any(x in state["ends"] + chunk for x in ("</html>", "</body>"))
        for anchor in scanner.feed(chunk, last):
            href = _HREF.match(anchor)[1].strip(" ")
            if href not in state["hrefs"] and not (state["spilled"] and self.seen.containsKey((href,))):
                state["hrefs"].add(href)
                yield Row(page_id=key, url=state["url"], kind="link", place=state["links"], anchor=anchor)
                state["links"] += 1
        state["tail"], state["clean"], state["ends"] = scanner.tail, scanner.clean, (state["ends"] + chunk)[-8:]
        if complete and not state["complete"]:
            state["complete"] = True
            yield Row(page_id=key, url=state["url"], kind="complete", place=state["links"], anchor=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (page,) = key
        state = self._state()
        for r in rows:
            state["url"] = state["url"] or r.url
            if state["next"] >= 0 and r.seq >= state["next"]:
                state["held"][r.seq] = (r.chunk or "", bool(r.last))
        while state["next"] >= 0 and (found := self._taken(state)):
            state["next"] += 1
            yield from self._read(page, state, *found)
            if found[1]:
                yield from self._end(page, state, "done")
        if state["next"] >= 0:
            # the first batch has no watermark yet: patience begins with the first there is
            now = timerValues.getCurrentWatermarkInMs()
            state["due"] = now + self.patience if now > 0 else 0
            # a timer that is set already stays, and is set anew when it rings too early
            if not state["timer"]:
                state["timer"] = now + self.patience
                self.handle.registerTimer(state["timer"])
        elif state["timer"]:
            self.handle.deleteTimer(state["timer"])
            state["timer"] = 0
        self._remember(state)

    def _end(self, page: int, state: dict, kind: str) -> Iterator[Row]:
        yield Row(page_id=page, url=state["url"], kind=kind, place=state["links"], anchor=None)
        if state["spilled"]:
            self.early.clear()
            self.seen.clear()
        state |= {"tail": "", "clean": "", "next": -1, "held": {}, "hrefs": set(), "spilled": False}  # an ended page is a number to remember

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (page,) = key
        state = self._state()
        state["timer"], now = 0, timerValues.getCurrentWatermarkInMs()
        if state["next"] >= 0 and not 0 < state["due"] <= now:
            state["due"] = state["timer"] = state["due"] or now + self.patience
            self.handle.registerTimer(state["timer"])
        elif state["next"] >= 0:
            yield from self._read(page, state, "", True)
            yield from self._end(page, state, "expired")
        self._remember(state)

    def close(self) -> None:
        pass


def _on_rocks(spark: SparkSession) -> None:
    """Keyed state with maps and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def events(chunks: DataFrame, patience: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """What ``Pages`` says of a stream of chunks: page_id, url, kind, place, anchor. Chunks later than ``lateness`` are lost."""
    _on_rocks(chunks.sparkSession)
    dealt = chunks.withWatermark("ts", lateness).groupBy("page_id")
    return dealt.transformWithState(statefulProcessor=Pages(patience), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def links(found: DataFrame) -> DataFrame:
    """page_id, place, target_url, anchor_text, rel of the links among ``events``, by the same expressions as over whole pages."""
    a = F.col("anchor")
    rows = found.where((F.col("kind") == "link") & ~a.contains("/cdn-cgi/l/email-protection"))
    return rows.select("page_id", "place", urls.join(F.col("url"), F.trim(F.regexp_extract(a, html.HREF, 1))).alias("target_url"), F.trim(F.regexp_replace(a, html.TAG, "")).alias("anchor_text"), F.lower(F.regexp_extract(a, html.REL, 1)).alias("rel"))


def chunked(pages: DataFrame, size: int) -> DataFrame:
    """Pages cut into chunks of ``size`` characters: page_id, url, seq, chunk, last, ts. The chunks of each page, however many, come within a minute, so none is late."""
    page = F.coalesce("html", F.lit(""))
    n = F.greatest(F.ceil(F.length(page) / F.lit(size)), F.lit(1)).cast("int")
    rows = pages.select("page_id", "url", page.alias("h"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("page_id", "url", F.col("k").cast("long").alias("seq"), F.col("h").substr(F.col("k") * size + 1, F.lit(size)).alias("chunk"), (F.col("k") == F.col("n") - 1).alias("last"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=(F.col("k") * 60 / F.col("n")).cast("decimal(18,6)"))).alias("ts"))


def _streamed(spark: SparkSession, name: str, sources: dict[str, DataFrame], run: Callable[..., DataFrame], files: int, last: dict[str, DataFrame] | None = None) -> DataFrame:
    """What ``run`` makes of ``sources``, each written to files in the shared folder and read again as a stream, a few files at a time.

    Files written together are read in any order. Rows of ``last`` come after all others: the stream stops and goes on with them.
    """
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    streams = {}
    for key, df in sources.items():
        df.write.parquet(f"{place}/{key}")
        streams[key] = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/{key}")
    out = run(**streams)
    go_on = lambda: out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    go_on()
    if last:
        for key, df in last.items():
            df.write.mode("append").parquet(f"{place}/{key}")
        go_on()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query(
    "links_incremental",
    f"""WITH {html.SQL}, a AS (SELECT page_id, url, regexp_extract_all(clean, {html._lit(html.ANCHOR)}) AS xs FROM pg),
    b AS (SELECT page_id, url, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM a),
    c AS (SELECT *, regexp_extract(x, {html._lit(html.HREF)}, 1) AS raw FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id, trim(raw) ORDER BY i) = 1))
    SELECT page_id, place, {html._duck_join('url', 'trim(raw)')} AS target_url, trim(regexp_replace(x, '<[^>]*>', '', 'g')) AS anchor_text, lower(regexp_extract(x, {html._lit(html.REL)}, 1)) AS rel FROM d WHERE NOT contains(x, '/cdn-cgi/l/email-protection')""",
)
def links_incremental(spark, sf_dir):
    """Links of every page, each when it is first seen, from chunks of 400 characters that arrive out of order over several batches."""
    # four batches of as many files as there are cores; a page's chunks go to different ones
    cores = max(spark.sparkContext.defaultParallelism, 1)
    chunks = chunked(texts(spark, sf_dir, "pages"), 400).repartition(4 * cores, "page_id", "seq")
    return _streamed(spark, "chunks", {"chunks": chunks}, lambda chunks: links(events(chunks)), cores)


def changes(base: DataFrame, later: DataFrame, within: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """url, change, severity, as ``history.diff`` tells changes, of two crawls as streams (url, page_id, title, word_count, html_bytes, ts).

    A page of the later crawl belongs to one of the base that came up to ``within`` before. Pages that found no partner come out
    when the watermarks say that none can come any more. A page that comes again within ``lateness`` is told once: the first row counts.
    """
    columns = ("page_id", "title", "word_count", "html_bytes", "ts", "url")
    once = lambda d: d.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["url"])
    x, y = (once(d).select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for d, side in ((base, "x"), (later, "y")))
    # in the state of a stream null meets null, so pages without a URL are kept from meeting
    near = F.expr(f"x_url = y_url AND x_url IS NOT NULL AND y_url IS NOT NULL AND y_ts >= x_ts AND y_ts <= x_ts + INTERVAL {within}")
    j = x.join(y, near, "full_outer")
    short = {"page_id": ("p", "q"), "title": ("t1", "t2"), "word_count": ("w1", "w2"), "html_bytes": ("s1", "s2")}
    pairs = j.select(F.coalesce("x_url", "y_url").alias("url"), *[F.col(f"{side}_{c}").alias(names[k]) for c, names in short.items() for k, side in enumerate("xy")])
    severity = F.when(F.col("change") == "removed", "critical").when(F.col("change").isin("title", "content"), "warning").otherwise("info")
    return pairs.select("url", F.explode(history.change_kinds()).alias("change")).withColumn("severity", severity)


def _at(column: Column, hours: int) -> Column:
    return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours), secs=(column % 3000).cast("decimal(18,6)"))


@query("monitor_stream", f"{history._TWO} SELECT url, change, CASE change WHEN 'removed' THEN 'critical' WHEN 'title' THEN 'warning' WHEN 'content' THEN 'warning' ELSE 'info' END AS severity FROM (SELECT url, unnest({history._KIND}) AS change FROM j)")
def monitor_stream(spark, sf_dir):
    """Two crawls as streams, the second a few hours behind; every page's changes, each told once although rows come twice."""
    first = lambda d: d.groupBy("url").agg(F.min_by(F.struct("page_id", "title", "word_count", "html_bytes"), "page_id").alias("r")).select("url", "r.*")
    base, later = (first(d).withColumn("ts", _at(F.col("page_id"), h)) for d, h in zip(history.crawls(spark, sf_dir), (0, 5)))
    # a row from much later lets the watermarks pass all others; of the two, the base's is the later one, so they meet nothing and stay in the state
    end = lambda d, day: spark.range(1).select(F.lit("end").alias("url"), *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in d.columns[1:-1]], F.lit(day).cast("timestamp").alias("ts"))
    twice = lambda d: d.unionByName(d).repartitionByRange(3, "ts")
    return _streamed(spark, "monitor", {"base": twice(base), "later": twice(later)}, changes, 1, {"base": end(base, "2024-03-02"), "later": end(later, "2024-03-01")})
