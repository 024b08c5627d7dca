"""A page as served against the page as rendered: what only scripts bring, and how the two texts align."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html
from .functions import urls
from .registry import query, texts

#: Codes, severities, categories and titles; share and number of words from which missing text counts.
CODES = [
    ("JSRENDER-TEXT-MISSING", "error", "seo", "Content only exists after JavaScript runs"),
    ("JSRENDER-LINKS-MISSING", "error", "links", "Links only exist after JavaScript runs"),
    ("JSRENDER-SCHEMA-MISSING", "warning", "schema", "Structured data is injected by JavaScript"),
    ("JSRENDER-META-REWRITTEN", "warning", "seo", "JavaScript rewrites the page metadata"),
]
SHARE, LEAST = 0.20, 25
_SILENT = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)"
_MARKUP = r"""(?s)<!--.*?(?:-->|\z)|<[a-zA-Z/!?](?:"[^"]*"|'[^']*'|[^"'>])*+>"""


def words(page: Column) -> Column:
    """The words of a page's text in order: letters and digits only, in lower case, of more than one byte."""
    text = F.regexp_replace(F.regexp_replace(page, _SILENT, ""), _MARKUP, " ")
    plain = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(plain, lambda w: F.octet_length(w) > 1)


def _links(page: Column, url: Column) -> Column:
    clean = F.regexp_replace(page, html.NOISE, " ")
    href = F.transform(F.regexp_extract_all(clean, F.lit(html.ANCHOR), 0), lambda a: urls.join(url, F.trim(F.regexp_extract(a, html.HREF, 1))))
    path = lambda u: F.concat(urls.path(u), F.when(u.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), F.regexp_extract(u, r"\?([^#]*)", 1))).otherwise(F.lit("")))
    return F.array_distinct(F.transform(F.filter(href, lambda u: u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), path))


def _blocks(page: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(page, r"(?is)<!--.*?-->", " "), F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1)
    return F.size(F.filter(found, lambda j: F.try_parse_json(j).isNotNull()))


def _decoded(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _told(page: Column) -> tuple[Column, Column]:
    """Title and description in the head; null where there is none."""
    head = F.regexp_extract(page, r"(?is)^(.*?)(?:</head>|\z)", 1)
    title = F.when(head.rlike(r"(?is)<title[^>]*>.*?</title>"), _decoded(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    metas = F.filter(F.regexp_extract_all(head, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda m: m.rlike(r"(?i)\sname\s*=\s*(?:\"description\"|'description'|description(?=[\s>/]))"))
    content = r"""(?i)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    first = F.get(F.filter(metas, lambda m: m.rlike(content)), F.lit(0))
    description = F.concat(*[F.regexp_extract(first, content, k) for k in (1, 2, 3)])
    return title, F.when(first.isNotNull(), _decoded(description))


def parity(pairs: DataFrame) -> DataFrame:
    """page_id, code, severity, category, title, missing of what pages (page_id, url, served, rendered) show only when rendered.

    Text counts from 25 missing words that are a fifth of the rendered ones; ``missing`` is how many words, links, blocks or
    texts. A page that was not rendered, or whose served text was not kept, has no findings. One row a page; nothing is shuffled.
    """
    s, r = F.col("served"), F.col("rendered")
    rows = pairs.where(s.isNotNull() & r.isNotNull()).select(
        "page_id",
        F.array_distinct(words(s)).alias("sw"),
        F.array_distinct(words(r)).alias("rw"),
        F.size(F.array_except(_links(r, F.col("url")), _links(s, F.col("url")))).alias("links"),
        (_blocks(r) - _blocks(s)).alias("blocks"),
        *[F.coalesce(a != b, F.lit(False)).cast("int").alias(n) for a, b, n in zip(_told(s), _told(r), ("t", "d"))],
    )
    rows = rows.select("page_id", F.size(F.array_except("rw", "sw")).alias("text"), F.size("rw").alias("all"), "links", "blocks", (F.col("t") + F.col("d")).alias("meta"))
    hits = [(F.col("text") >= LEAST) & (F.col("text") / F.col("all") >= SHARE), F.col("links") > 0, F.col("blocks") > 0, F.col("meta") > 0]
    counts = [F.col(c) for c in ("text", "links", "blocks", "meta")]
    each = [F.when(hit, F.struct(*[F.lit(x).alias(n) for n, x in zip(("code", "severity", "category", "title"), code)], n.cast("long").alias("missing"))) for hit, code, n in zip(hits, CODES, counts)]
    return rows.select("page_id", F.inline(F.array_compact(F.array(*each))))


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each word of b a number whose bit i is 0 where a[: i + 1] shares one word more with that part of b than a[:i]."""
    full, places = (1 << len(a)) - 1, {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    bits = {w: sum(1 << i for i in at) if len(at) < 64 else int("".join("1" if x == w else "0" for x in reversed(a)), 2) for w, at in places.items()}
    v = full
    for w in b:
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """How many words each start of a, from the empty one on, shares with b in order."""
    v = (1 << len(a)) - 1
    for v in _rows(a, b):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest(a: list[str], b: list[str], room: int = 1 << 26) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence. Bits of a row are worked on together; beyond ``room`` bytes of rows b is halved."""
    if not a or not b:
        return []
    width = len(a) // 8 + 1
    if width * len(b) > room and len(b) > 1:
        half = len(b) // 2
        at = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        return longest(a[:at], b[:half], room) + [(i + at, j + half) for i, j in longest(a[at:], b[half:], room)]
    rows = [v.to_bytes(width, "little") for v in _rows(a, b)]
    grows = lambda i, j: not rows[j][i >> 3] >> (i & 7) & 1
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if not grows(i, j):
            i -= 1
        elif j and grows(i, j - 1):
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both: words that both sides have once are anchors.

    Equal ends are paired first. Between the longest rising chain of anchors the same is done again; where there are
    no anchors, a longest common subsequence is paired, so a text with parts taken out loses no word. Time is near the
    number of words for each level, and the product of both lengths over the bits of a machine word without anchors.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place]
        # the longest chain of anchors that rises on the other side too
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(anchors):
            at = bisect_left(tops, j)
            back.append(ends[at - 1] if at else -1)
            tops[at : at + 1], ends[at : at + 1] = [j], [k]
        chain = []
        k = ends[-1] if ends else -1
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        chain.reverse()
        if not chain:
            common = once_a.keys() & once_b.keys()
            here, there = ([i for i in range(x0, x1) if x[i] in common] for x, x0, x1 in ((a, a0, a1), (b, b0, b1)))
            out += [(here[i], there[j]) for i, j in longest([a[i] for i in here], [b[j] for j in there])]
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
        out += chain
    return sorted(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, served, rendered = (batch.column(c).to_pylist() for c in ("page_id", "served", "rendered"))
        rows = []
        for page, a, b in zip(ids, served, rendered):
            pairs = [(-1, -1), *aligned(a or [], b or []), (len(a or []), len(b or []))]
            for (i, j), (k, m) in zip(pairs[:-1], pairs[1:]):
                if k > i + 1:
                    rows.append((page, "lost", i + 1, k - i - 1, " ".join(a[i + 1 : k])))
                if m > j + 1:
                    rows.append((page, "inserted", j + 1, m - j - 1, " ".join(b[j + 1 : m])))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["page_id", "kind", "place", "n", "words"])


def alignment(pairs: DataFrame) -> DataFrame:
    """page_id, kind, place, n, words: runs of words that rendering put in or took away, by aligning the two texts of each page (page_id, served, rendered)."""
    rows = pairs.where("served IS NOT NULL AND rendered IS NOT NULL").select("page_id", words(F.col("served")).alias("served"), words(F.col("rendered")).alias("rendered"))
    return rows.mapInArrow(_runs, "page_id long, kind string, place long, n long, words string")


def made(pages: DataFrame) -> DataFrame:
    """page_id, url, served, rendered: the given pages as rendered, and what might have been served, with parts missing by the page's number."""
    p, page = F.col("page_id"), F.coalesce("html", F.lit(""))
    served = F.when(p % 3 == 0, F.regexp_replace(page, r"(?s)<article>.*?(</article>|\z)", "<article></article>")).otherwise(page)
    served = F.when(p % 4 == 1, F.regexp_replace(served, r"(?s)<nav>.*?</nav>", "<nav></nav>")).otherwise(served)
    served = F.when(p % 5 == 2, F.regexp_replace(served, r"(?s)<title>.*?</title>", "<title>Loading</title>")).otherwise(served)
    block = '<script type="application/ld+json">{"@type": "Thing"}</script></head>'
    return pages.select("page_id", "url", F.when(p % 7 != 6, served).alias("served"), F.when(p % 6 == 3, F.replace(page, F.lit("</head>"), F.lit(block))).otherwise(page).alias("rendered"))


_WORDS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '(?is)<script.*?(</script>|\z)|<style.*?(</style>|\z)', '', 'g'), '(?s)<!--.*?(-->|\z)|<[a-zA-Z/!?]([^>]*)>', ' ', 'g'), '\s+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g'))), lambda w: strlen(w) > 1)"
_PAIRS = r"""p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages WHERE page_id % 7 <> 6),
a AS (SELECT page_id, h, CASE WHEN page_id % 3 = 0 THEN regexp_replace(h, '(?s)<article>.*?(</article>|$)', '<article></article>') ELSE h END AS s FROM p),
b AS (SELECT page_id, h, CASE WHEN page_id % 4 = 1 THEN regexp_replace(s, '(?s)<nav>.*?</nav>', '<nav></nav>') ELSE s END AS s FROM a),
c AS (SELECT page_id, h, CASE WHEN page_id % 5 = 2 THEN regexp_replace(s, '(?s)<title>.*?</title>', '<title>Loading</title>') ELSE s END AS s FROM b)"""


@query(
    "render_parity",
    rf"""WITH {_PAIRS}, w AS (SELECT page_id, list_distinct({_WORDS.format('h')}) AS rw, list_distinct({_WORDS.format('s')}) AS sw,
      len(list_distinct(regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1))) AS nav, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS title FROM c),
    n AS (SELECT *, len(list_filter(rw, lambda x: NOT list_contains(sw, x))) AS gone FROM w)
    SELECT page_id, '{CODES[0][0]}' AS code, 'error' AS severity, 'seo' AS category, 'Content only exists after JavaScript runs' AS title, gone AS missing FROM n WHERE gone >= 25 AND gone / len(rw) >= 0.2
    UNION ALL SELECT page_id, 'JSRENDER-LINKS-MISSING', 'error', 'links', 'Links only exist after JavaScript runs', nav FROM n WHERE page_id % 4 = 1 AND nav > 0
    UNION ALL SELECT page_id, 'JSRENDER-SCHEMA-MISSING', 'warning', 'schema', 'Structured data is injected by JavaScript', 1 FROM n WHERE page_id % 6 = 3
    UNION ALL SELECT page_id, 'JSRENDER-META-REWRITTEN', 'warning', 'seo', 'JavaScript rewrites the page metadata', 1 FROM n WHERE page_id % 5 = 2""",
)
def render_parity(spark, sf_dir):
    """What every page would show only when rendered, with parts of it taken from what was served."""
    return parity(made(texts(spark, sf_dir, "pages")))


@query(
    "render_alignment",
    rf"""WITH {_PAIRS}, w AS (SELECT page_id, {_WORDS.format('h')} AS rw, {_WORDS.format('s')} AS sw FROM c),
    n AS (SELECT page_id, len(rw) AS r, len(sw) AS s FROM w WHERE page_id % 5 <> 2)
    SELECT page_id, 'inserted' AS kind, r - s AS n FROM n WHERE r > s""",
)
def render_alignment(spark, sf_dir):
    """How many words rendering puts in and takes away, of every page whose title stays."""
    runs = alignment(made(texts(spark, sf_dir, "pages")).where("page_id % 5 <> 2"))
    return runs.groupBy("page_id", "kind").agg(F.sum("n").alias("n"))
