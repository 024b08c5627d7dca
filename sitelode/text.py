"""Text analytics: readability, keywords, sentiment, exact duplicates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import html
from .registry import query, texts

#: Words with at least so many syllables are complex.
COMPLEX = 3
# Words of praise and of blame.
POSITIVE = "good great excellent amazing wonderful best love happy fantastic superb outstanding perfect beautiful brilliant awesome nice pleasant delightful impressive remarkable magnificent splendid fabulous terrific".split()
NEGATIVE = "bad terrible horrible awful worst hate sad ugly poor disappointing boring annoying frustrating difficult broken failed error wrong problem issue bug fail crash dead".split()
# Words that are no keywords.
STOP_WORDS = """a an the and or but in on at to for of with by is are was were be been being have has had do does did will would could
should may might shall can it its this that these those i you he she we they me him her us them my your his our their what which who whom
where when why how all each every both few more most other some such no nor not only own same so than too very just about above after again
also as before between down from here if into then there through under until up""".split()
# Words that stand before a person's name; those that end in a dot must be so written somewhere in the text.
PEOPLE = "mr. mrs. ms. dr. prof. sir lord president ceo cto founder author by".split()
# Small words inside a name.
PARTICLES = "de van von la le".split()
# Parts of words that end an organization's or a place's name.
ORGANIZATIONS = "llc corporation company organization university institute foundation association group partners".split()
PLACES = "city state country province district region street avenue boulevard road lane square park mountain river lake island bay coast valley".split()
# Phrases of pages that say they are not there.
GONE = ["page not found", "404 not found", "the page you requested", "does not exist", "has been removed", "no longer available", "error 404", "not found", "sorry, we couldn't find", "this page is no longer available", "the requested url was not found"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Each terminator counts; a text has one sentence at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]")), F.lit(1))


def sentence_runs(text: Column) -> Column:
    """Runs of terminators count once."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]+"))


def syllables(word: Column) -> Column:
    """Vowel groups, a final e taken off if another is left; one at least, one for words of up to two letters."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(F.length(w) <= 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.when((groups > 1) & w.endswith("e"), groups - 1).otherwise(groups)))


def bare(word: Column) -> Column:
    """A word in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def keyword_tokens(text: Column) -> Column:
    """White-space words, bare, over two bytes, no stop words. The text is made bare at once: that is much faster than word by word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N} \t\n\x0B\f\r]+", "")
    return F.filter(F.split(plain, r"[ \t\n\x0B\f\r]+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_SYL = "CASE WHEN length(w) <= 2 THEN 1 ELSE greatest(1, CASE WHEN len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 AND ends_with(lower(w), 'e') THEN len(regexp_extract_all(lower(w), '[aeiouy]+')) - 1 ELSE len(regexp_extract_all(lower(w), '[aeiouy]+')) END) END"
_STOPS = """'a','an','the','and','or','but','in','on','at','to','for','of','with','by','is','are','was','were','be','been','being','have','has','had','do','does','did',
'will','would','could','should','may','might','shall','can','it','its','this','that','these','those','i','you','he','she','we','they','me','him','her','us','them','my',
'your','his','our','their','what','which','who','whom','where','when','why','how','all','each','every','both','few','more','most','other','some','such','no','nor','not',
'only','own','same','so','than','too','very','just','about','above','after','again','also','as','before','between','down','from','here','if','into','then','there',
'through','under','until','up'"""


def _bare(word: str) -> str:
    return f"regexp_replace(lower({word}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: {_bare('w')}), lambda w: strlen(w) > 2 AND w NOT IN ({_STOPS}))"


_TOKENS = _tokens("text")
_COUNTS = f"""{_DOCS}, c AS (
  SELECT doc_id, len({_WORDS}) AS words, greatest(len(regexp_extract_all(text, '[.!?]')), 1) AS sentences, len(regexp_extract_all(text, '[.!?]+')) AS runs,
    coalesce(list_sum(list_transform({_WORDS}, lambda w: {_SYL})), 0)::BIGINT AS syllables, len(list_filter({_WORDS}, lambda w: ({_SYL}) >= {COMPLEX})) AS complex,
    len(regexp_extract_all(text, '\\p{{L}}')) AS letters, length(text) AS chars FROM d)"""


def counts(docs: DataFrame) -> DataFrame:
    w = words(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", w)
    syl = F.transform("w", syllables)
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("words"),
        sentences(F.col("text")).cast("long").alias("sentences"),
        sentence_runs(F.col("text")).cast("long").alias("runs"),
        F.aggregate(syl, F.lit(0).cast("long"), lambda a, x: a + x).alias("syllables"),
        F.size(F.filter(syl, lambda x: x >= COMPLEX)).cast("long").alias("complex"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"),
        F.length("text").cast("long").alias("chars"),
    )


@query("sentence_stats", f"WITH {_COUNTS} SELECT * FROM c")
def sentence_stats(spark, sf_dir):
    return counts(texts(spark, sf_dir, "documents"))


_READ = """doc_id, round(0.39 * (words * 1.0 / sentences) + 11.8 * (syllables * 1.0 / words) - 15.59, 6) AS flesch_kincaid,
  round(greatest(0.0, least(100.0, 206.835 - 1.015 * (words * 1.0 / sentences) - 84.6 * (syllables * 1.0 / words))), 6) AS reading_ease,
  round(0.0588 * (letters * 100.0 / words) - 0.296 * (sentences * 100.0 / words) - 15.8, 6) AS coleman_liau,
  round(4.71 * (chars * 1.0 / words) + 0.5 * (words * 1.0 / sentences) - 21.43, 6) AS ari,
  round(0.4 * ((words * 1.0 / sentences) + 100.0 * (complex * 1.0 / words)), 6) AS gunning_fog"""


def _double(e: str) -> str:
    """Decimal literals of SQL as doubles, which both engines compute with alike."""
    return re.sub(r"\b(\d+\.\d+)\b", r"CAST(\1 AS DOUBLE)", e)


_EASE = [(90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult")]


@query("readability", f"WITH {_COUNTS} SELECT {_double(_READ)} FROM c WHERE words > 0")
def readability(spark, sf_dir):
    """Texts with words only; a text has one sentence at least."""
    return counts(texts(spark, sf_dir, "documents")).where("words > 0").selectExpr(*_split(_double(_READ)))


def _split(select: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, item = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


@query("reading_ease_labels", f"WITH {_COUNTS}, r AS (SELECT {_double(_READ)} FROM c WHERE words > 0) SELECT CASE {' '.join(f'''WHEN reading_ease >= {b} THEN '{n}' ''' for b, n in _EASE)} ELSE 'very difficult' END AS label, count(*) AS n FROM r GROUP BY 1")
def reading_ease_labels(spark, sf_dir):
    label = F
    for b, n in _EASE:
        label = label.when(F.col("reading_ease") >= b, F.lit(n))
    return readability(spark, sf_dir).groupBy(label.otherwise("very difficult").alias("label")).agg(F.count("*").alias("n"))


@query("unique_word_ratio", f"WITH {_DOCS} SELECT doc_id, round(len(list_distinct(list_transform({_WORDS}, lambda w: lower(w)))) * CAST(1 AS DOUBLE) / len({_WORDS}), 6) AS ratio FROM d WHERE len({_WORDS}) > 100")
def unique_word_ratio(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 100)
    return rows.select("doc_id", F.round(F.size(F.array_distinct(F.transform("w", F.lower))) / F.size("w"), 6).alias("ratio"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, term, total, n of rows (doc_id, t) sorted by doc_id; rows of one id with as many tokens count as one document."""
    doc, counts, rows = None, {}, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["doc_id", "term", "total", "n"])

    told = lambda: [(doc, w, total, n) for total, found in counts.items() for w, n in found.items()]
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i != doc:
                rows += told()
                doc, counts = i, {}
            counts.setdefault(len(t), Counter()).update(t)
        yield batch()
        rows = []
    rows = told()
    yield batch()


def _terms(spark, sf_dir) -> DataFrame:
    """doc_id, term, total, n: tokens are shuffled as whole documents, not as one row a term."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", keyword_tokens(F.col("text")).alias("t"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_term_counts, "doc_id long, term string, total int, n long")


_TF = f"{_DOCS}, t AS (SELECT doc_id, {_TOKENS} AS t FROM d), f AS (SELECT doc_id, total, term, count(*) AS n FROM (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM t) GROUP BY ALL)"


@query("keyword_tf", f"WITH {_TF} SELECT doc_id, term, round(n * CAST(1 AS DOUBLE) / total, 9) AS tf FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 10")
def keyword_tf(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return _terms(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 10").select("doc_id", "term", F.round(F.col("n") / F.col("total"), 9).alias("tf"))


@query(
    "keyword_tfidf",
    f"WITH {_TF}, x AS (SELECT doc_id, f.term, round(n * CAST(1 AS DOUBLE) / total * (ln((SELECT count(*) FROM documents) * CAST(1 AS DOUBLE) / df) + 1), 6) AS tfidf FROM f JOIN (SELECT term, count(*) AS df FROM f GROUP BY term) g ON f.term = g.term) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) <= 10",
)
def keyword_tfidf(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    total = texts(spark, sf_dir, "documents").agg(F.count("*").alias("docs"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    rows = terms.join(df, "term").crossJoin(F.broadcast(total)).select("doc_id", "term", F.round(F.col("n") / F.col("total") * (F.log(F.col("docs") / F.col("df")) + 1), 6).alias("tfidf"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term"))).where("k <= 10").drop("k")


@query("keyword_density", f"WITH {_TF}, w AS (SELECT doc_id, len({_WORDS}) AS words FROM d) SELECT doc_id, term, round(n * CAST(100 AS DOUBLE) / words, 6) AS density FROM f JOIN w USING (doc_id) WHERE n * CAST(100 AS DOUBLE) / words >= 1.5")
def keyword_density(spark, sf_dir):
    """Prominent keywords: 1.5 % of all words or more."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("words"), keyword_tokens(F.col("text")).alias("t"))
    rows = docs.select("doc_id", "words", F.explode("t").alias("term")).groupBy("doc_id", "words", "term").agg(F.count("*").alias("n"))
    return rows.withColumn("d", F.col("n") * 100.0 / F.col("words")).where("d >= 1.5").select("doc_id", "term", F.round("d", 6).alias("density"))


#: Pairs that a task holds before it gives their counts away.
HELD = 4_000_000


def _pair_counts(batches: Iterator[pa.RecordBatch], window: int, held: int) -> Iterator[pa.RecordBatch]:
    """a, b, n of the pairs in token arrays ``t``, counted over up to ``held`` pairs at a time; the same pair may come again."""
    texts, size = [], 0
    for batch in batches:
        texts.append(batch.column(0))
        size += len(batch.column(0).flatten()) * window
        if size >= held:
            yield from _counted(texts, window)
            texts, size = [], 0
    if texts:
        yield from _counted(texts, window)


def _counted(texts: list[pa.Array], window: int) -> Iterator[pa.RecordBatch]:
    tokens = pa.chunked_array([t.flatten() for t in texts]).combine_chunks()
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    row = np.repeat(np.arange(sum(len(t) for t in texts)), np.concatenate([pc.list_value_length(t).to_numpy(zero_copy_only=False) for t in texts]).astype(np.int64))
    keys = []
    for k in range(1, window + 1):
        same = row[:-k] == row[k:]
        x, y = code[:-k][same], code[k:][same]
        keys.append(np.minimum(x, y) * len(order) + np.maximum(x, y))
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    words = coded.dictionary.take(pa.array(order))
    for at in range(0, len(found), 100_000):
        part = found[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([words.take(pa.array(part // len(order))), words.take(pa.array(part % len(order))), pa.array(n[at : at + 100_000])], names=["a", "b", "n"])


def cooccurring(docs: DataFrame, window: int = 3, held: int = HELD) -> DataFrame:
    """a, b, n: all pairs of words at most ``window`` tokens apart, a word with itself too. Tasks count before rows are shuffled."""
    rows = docs.select(keyword_tokens(F.col("text")).alias("t"))
    return rows.mapInArrow(lambda batches: _pair_counts(batches, window, held), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


_PAIRS = "SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT t[i] AS a, t[i + k] AS b FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM t), range(1, 4) AS r(k) WHERE i + k <= len(t)) GROUP BY ALL"


@query("cooccurrence", f"WITH {_TF} {_PAIRS}")
def cooccurrence(spark, sf_dir, window=3):
    """Every pair of keywords at most ``window`` apart, a word with itself too."""
    return cooccurring(texts(spark, sf_dir, "documents"), window)


@query("cooccurrence_top", f"WITH {_TF}, p AS ({_PAIRS}) SELECT * FROM p ORDER BY n DESC, a, b LIMIT 5")
def cooccurrence_top(spark, sf_dir, most=5):
    """The pairs that a report names."""
    return cooccurrence(spark, sf_dir).orderBy(F.desc("n"), "a", "b").limit(most)


@query(
    "sentiment",
    f"""WITH {_DOCS}, w AS (SELECT doc_id, list_transform({_WORDS}, lambda w: {_bare('w')}) AS w FROM d),
    s AS (SELECT doc_id, len(w) AS total,
      len(list_filter(w, lambda x: x IN ('good', 'great', 'excellent', 'amazing', 'wonderful', 'best', 'love', 'happy', 'fantastic', 'superb', 'outstanding', 'perfect', 'beautiful', 'brilliant', 'awesome', 'nice', 'pleasant', 'delightful', 'impressive', 'remarkable', 'magnificent', 'splendid', 'fabulous', 'terrific'))) AS p,
      len(list_filter(w, lambda x: x IN ('bad', 'terrible', 'horrible', 'awful', 'worst', 'hate', 'sad', 'ugly', 'poor', 'disappointing', 'boring', 'annoying', 'frustrating', 'difficult', 'broken', 'failed', 'error', 'wrong', 'problem', 'issue', 'bug', 'fail', 'crash', 'dead'))) AS n FROM w),
    r AS (SELECT doc_id, p, n, CASE WHEN total = 0 THEN 0 ELSE round((p - n) * CAST(100 AS DOUBLE) / total) / 100 END AS score FROM s)
    SELECT doc_id, p AS positive, n AS negative, score, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM r""",
)
def sentiment(spark, sf_dir):
    """Words of praise less words of blame, as a share of all words, to two places."""
    hits = lambda xs: F.size(F.filter("w", lambda x: x.isin(*xs))).cast("long")
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.transform(words(F.col("text")), bare).alias("w")).select("doc_id", F.size("w").alias("total"), hits(POSITIVE).alias("positive"), hits(NEGATIVE).alias("negative"))
    score = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round((F.col("positive") - F.col("negative")) * 100.0 / F.col("total")) / 100)
    label = F.when(F.col("score") > 0.05, "positive").when(F.col("score") < -0.05, "negative").otherwise("neutral")
    return rows.withColumn("score", score).select("doc_id", "positive", "negative", "score", label.alias("label"))


@query("exact_dup_documents", "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dup_documents(spark, sf_dir):
    return texts(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def soft_404(body: Column) -> Column:
    """Does a page that was served well say that it is not there?"""
    low = F.lower(body)
    return reduce(Column.__or__, [low.contains(x) for x in GONE])


_GONE = "'page not found|404 not found|the page you requested|does not exist|has been removed|no longer available|error 404|not found|sorry, we couldn''t find|this page is no longer available|the requested url was not found'"


@query("soft_404", f"SELECT page_id, regexp_matches(lower(coalesce(html, '')), {_GONE}) AS soft_404 FROM pages")
def soft_404_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", soft_404(F.coalesce("html", F.lit(""))).alias("soft_404"))


_NOTICES = ["", " Page NOT found", " It has been removed.", " 404", " Error 404"]


@query("soft_404_documents", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), {_GONE}) OR doc_id % 5 IN (1, 2, 4)")
def soft_404_documents(spark, sf_dir):
    """The same test on plain texts, with a notice put at the end by the document's number, as none has one."""
    notice = F.element_at(F.array(*[F.lit(x) for x in _NOTICES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return texts(spark, sf_dir, "documents").where(soft_404(F.concat(F.coalesce("text", F.lit("")), notice))).select("doc_id")


def people(text: Column) -> Column:
    """Names after titles and bylines: the words that follow, as long as they begin with a capital letter or are particles."""
    w = words(text)
    clean = F.transform(w, bare)
    named = F.transform(w, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}-]", ""))
    goes_on = F.transform(named, lambda x: F.coalesce(F.substring(x, 1, 1).rlike(r"^\p{Lu}"), F.lit(False)) | F.lower(x).isin(*PARTICLES))
    low = F.lower(text)
    wanted = F.filter(F.array(*[F.when(low.contains(p), F.lit(p.rstrip("."))) for p in PEOPLE]), lambda x: x.isNotNull())
    # an index of the first word that does not go on, from each place on
    rows = F.struct(clean.alias("clean"), named.alias("named"), F.concat(goes_on, F.array(F.lit(False))).alias("on"), wanted.alias("wanted"))
    return F.transform(
        F.array(rows),
        lambda r: F.array_sort(
            F.array_distinct(
                F.filter(
                    F.transform(
                        F.filter(F.sequence(F.lit(1), F.greatest(F.size(r["clean"]), F.lit(1))), lambda i: F.coalesce(F.array_contains(r["wanted"], F.try_element_at(r["clean"], i)), F.lit(False))),
                        lambda i: F.array_join(F.slice(r["named"], i + 1, F.greatest(F.array_position(F.slice(r["on"], i + 1, F.size(r["on"])), False).cast("int") - 1, F.lit(0))), " "),
                    ),
                    lambda x: x != "",
                )
            )
        ),
    )[0]


def ended_by(text: Column, marks: list[str]) -> Column:
    """Words with one of ``marks`` in them, each with up to two words before it in its sentence."""
    mark = "|".join(marks)

    def of_sentence(s: Column) -> Column:
        w = words(s)
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.coalesce(F.lower(F.try_element_at(w, i)).rlike(mark), F.lit(False)))
        return F.transform(at, lambda i: F.array_join(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " "))

    said = F.flatten(F.transform(F.filter(F.split(text, "[.!?]"), lambda s: F.lower(s).rlike(mark)), of_sentence))
    return F.array_sort(F.array_distinct(F.filter(said, lambda x: F.octet_length(x) > 3)))


def _duck_ended_by(marks: str) -> str:
    w = "regexp_split_to_array(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+')"
    each = f"list_transform(list_filter(range(1, len({w}) + 1), lambda i: regexp_matches(lower(({w})[i]), '{marks}')), lambda i: array_to_string(({w})[greatest(i - 2, 1):i], ' '))"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_matches(lower(s), '{marks}')), lambda s: {each})), lambda x: strlen(x) > 3)))"


@query(
    "entities",
    f"""WITH {_DOCS} SELECT doc_id, {_duck_ended_by('llc|corporation|company|organization|university|institute|foundation|association|group|partners')} AS organizations,
    {_duck_ended_by('city|state|country|province|district|region|street|avenue|boulevard|road|lane|square|park|mountain|river|lake|island|bay|coast|valley')} AS locations FROM d""",
)
def entities(spark, sf_dir):
    """Organizations and places by the words that end their names."""
    t = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir, "documents").select("doc_id", ended_by(t, ORGANIZATIONS).alias("organizations"), ended_by(t, PLACES).alias("locations"))


@query(
    "entities_people",
    f"""WITH {_DOCS}, w AS (SELECT doc_id, lower(text) AS low, {_WORDS} AS w FROM d),
    c AS (SELECT doc_id, low, list_transform(w, lambda x: {_bare('x')}) AS clean, list_transform(w, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}-]', '', 'g')) AS named FROM w),
    i AS (SELECT doc_id, clean, named, unnest(range(1, len(clean) + 1)) AS i, low FROM c),
    h AS (SELECT doc_id, i, named[i + 1:] AS rest FROM i WHERE clean[i] IN ('sir', 'lord', 'president', 'ceo', 'cto', 'founder', 'author', 'by') OR (clean[i] IN ('mr', 'mrs', 'ms', 'dr', 'prof') AND contains(low, clean[i] || '.'))),
    n AS (SELECT doc_id, rest, list_position(list_concat(list_transform(rest, lambda x: regexp_matches(x, '^\\p{{Lu}}') OR lower(x) IN ('de', 'van', 'von', 'la', 'le')), [false]), false) - 1 AS k FROM h)
    SELECT doc_id, array_to_string(rest[1:k], ' ') AS person FROM n WHERE k > 0 AND array_to_string(rest[1:k], ' ') <> '' GROUP BY ALL""",
)
def entities_people(spark, sf_dir):
    """Each document's named persons."""
    return texts(spark, sf_dir, "documents").select("doc_id", F.explode(people(F.coalesce("text", F.lit("")))).alias("person"))


_PF = f"WITH {html.SQL}"


@query(
    "topic_terms",
    f"""{_PF}, t AS (SELECT page_id, unnest(list_transform(regexp_split_to_array(heading_text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: {_bare('w')})) AS term FROM pf WHERE word_count > 0),
    n AS (SELECT page_id, term, count(*) AS n FROM t WHERE strlen(term) > 3 AND term NOT IN ({_STOPS}) GROUP BY ALL)
    SELECT page_id, term, n FROM n QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, term) <= 5""",
)
def topic_terms(spark, sf_dir, most=5):
    """The most frequent words of a page's headings, five for each page: that is the report's measure."""
    facts = html.page_facts(texts(spark, sf_dir, "pages")).where("word_count > 0")
    terms = facts.select("page_id", F.explode(F.transform(words(F.col("heading_text")), bare)).alias("term")).where((F.octet_length("term") > 3) & ~F.col("term").isin(*STOP_WORDS))
    order = Window.partitionBy("page_id").orderBy(F.desc("n"), "term")
    return terms.groupBy("page_id", "term").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


@query(
    "topic_coverage",
    f"""{_PF}, t AS (SELECT page_id, list_distinct({_tokens('heading_text')}) AS h, list_distinct({_tokens('body')}) AS b FROM pf JOIN (SELECT page_id, body FROM pg) USING (page_id) WHERE heading_count > 0 AND word_count > 0)
    SELECT page_id, len(h) AS keywords, len(list_intersect(h, b)) AS covered, len(list_intersect(h, b)) * CAST(1 AS DOUBLE) / len(h) < 0.3 AS lacks FROM t WHERE len(h) > 0 AND len(b) > 0""",
)
def topic_coverage(spark, sf_dir):
    """Which share of the headings' keywords the body has; under 0.3 it lacks coverage."""
    parsed = html.parse(texts(spark, sf_dir, "pages"))
    distinct = lambda c: F.array_distinct(keyword_tokens(c))
    rows = parsed.where((F.size("headings") > 0) & (F.col("word_count") > 0)).select("page_id", distinct(F.array_join(F.transform("headings", lambda x: x["text"]), " ")).alias("h"), distinct(F.col("body")).alias("b"))
    rows = rows.where("size(h) > 0 AND size(b) > 0").select("page_id", F.size("h").cast("long").alias("keywords"), F.size(F.array_intersect("h", "b")).cast("long").alias("covered"))
    return rows.withColumn("lacks", F.col("covered") / F.col("keywords") < 0.3)


@query(
    "title_stuffing",
    f"""{_PF}, t AS (SELECT page_id, list_distinct({_tokens('title')}) AS k, list_filter(regexp_split_to_array(lower(body), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM pf JOIN (SELECT page_id, body FROM pg) USING (page_id) WHERE title IS NOT NULL),
    s AS (SELECT page_id, len(w) AS total, unnest(k) AS keyword, w FROM t WHERE len(w) >= 100)
    SELECT page_id, keyword, len(list_filter(w, lambda x: contains(x, keyword))) AS n, round(100.0 * len(list_filter(w, lambda x: contains(x, keyword))) / total, 6)::DOUBLE AS share, 100.0 * len(list_filter(w, lambda x: contains(x, keyword))) / total > 3 AS stuffed FROM s""",
)
def title_stuffing(spark, sf_dir):
    """For each keyword of a title the share of the body's words that contain it; over 3 % the page is stuffed with it."""
    parsed = html.parse(texts(spark, sf_dir, "pages")).where("title IS NOT NULL")
    rows = parsed.select("page_id", words(F.lower("body")).alias("w"), F.array_distinct(keyword_tokens(F.col("title"))).alias("k")).where("size(w) >= 100")
    each = rows.select("page_id", "w", F.explode("k").alias("keyword")).withColumn("n", F.expr("size(filter(w, x -> contains(x, keyword)))").cast("long"))
    share = F.col("n") * 100.0 / F.size("w")
    return each.select("page_id", "keyword", "n", F.round(share, 6).alias("share"), (share > 3).alias("stuffed"))


def overlap(a: Column, b: Column) -> Column:
    """Words of a that b has, over the root of the product of their numbers; words are runs of letters and digits over two bytes."""
    split = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 2)
    x, y = split(a), split(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)


_WX, _WY = (f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 2)" for c in ("a", "b"))


@query(
    "text_overlap",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations),
    x AS (SELECT conv_id, turn, {_WX} AS x, {_WY} AS y FROM t) SELECT conv_id, turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_filter(x, lambda w: list_contains(y, w))) / sqrt(len(x) * len(y)), 6) ELSE 0 END AS overlap FROM x""",
)
def text_overlap(spark, sf_dir):
    """The overlap that is taken of titles and descriptions, here of each turn and the next (the given pages have no descriptions)."""
    t = texts(spark, sf_dir, "conversations")
    rows = t.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"), F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("b"))
    return rows.select("conv_id", "turn", F.round(overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


# Bounds of school grades.
GRADES = [(1, "kindergarten"), (6, "elementary school"), (9, "middle school"), (13, "high school"), (16, "college")]


@query("grade_labels", f"WITH {_COUNTS}, r AS (SELECT {_double(_READ)} FROM c WHERE words > 0) SELECT CASE WHEN flesch_kincaid < 1 THEN 'kindergarten' WHEN flesch_kincaid < 6 THEN 'elementary school' WHEN flesch_kincaid < 9 THEN 'middle school' WHEN flesch_kincaid < 13 THEN 'high school' WHEN flesch_kincaid < 16 THEN 'college' ELSE 'postgraduate' END AS label, count(*) AS n FROM r GROUP BY 1")
def grade_labels(spark, sf_dir):
    label = F
    for bound, name in GRADES:
        label = label.when(F.col("flesch_kincaid") < bound, F.lit(name))
    return readability(spark, sf_dir).groupBy(label.otherwise("postgraduate").alias("label")).agg(F.count("*").alias("n"))
