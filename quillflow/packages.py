"""Registered queries over packaged books, runs and models, and their DuckDB SQL.

The driver's tables hold no packages, so these queries make them: a book for each lang, source and range of
ids, with an XHTML document for each row of documents, and run the operators on those. A document holds the
row's whole text, a paragraph for each line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C
from . import schemas as S
from . import scratch
from .functions import text as X
from .operators import fragments, inspect, queue, sampling, scope, summary, translate
from .sources import archive

_XHTML, _OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
_CONTAINER = "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OEBPS/content.opf'/></rootfiles></container>"


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


#: Ids that share a book: no book has more documents.
BOOK_IDS = 2000


def _escaped(c: Column) -> Column:
    """Text as XML: what XML 1.0 can't hold is a space, and so is a return, which parsers would change."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", " ")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, book, source and the escaped lines of every document."""
    d = C._table(spark, sf_dir, "documents")
    source = F.coalesce("source", F.lit("none"))
    book = say(F.coalesce("lang", F.lit("none")), "-", source, "-", F.floor(F.col("doc_id") / BOOK_IDS).cast("string"))
    return d.select("doc_id", book.alias("book"), source.alias("source"), F.split(_escaped(F.coalesce("text", F.lit(""))), "\n").alias("lines"))


#: raw: the lines as a reader of the XML sees them; lines: as they stand in it.
_DOCS_SQL = rf"""
docs AS (
  SELECT doc_id, book, source, raw, list_transform(raw, lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS lines FROM (
    SELECT doc_id, coalesce(lang, 'none') || '-' || coalesce(source, 'none') || '-' || CAST(floor(doc_id / {BOOK_IDS}) AS BIGINT) AS book, coalesce(source, 'none') AS source,
           string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', ' ', 'g'), chr(10)) AS raw FROM documents))"""


def _path() -> Column:
    return say("OEBPS/text/d", F.col("doc_id").cast("string"), ".xhtml")


def _document() -> Column:
    """Every second one has an empty title; every third paragraph has text after it; the last list item is blank."""
    title = F.when(F.col("doc_id") % 2 == 0, "").otherwise(say("Title ", F.col("doc_id").cast("string")))
    head = say(f"<html xmlns='{_XHTML}' xmlns:epub='{_OPS}'><head><title>", title, "</title></head>")
    paragraphs = F.transform("lines", lambda x, k: say("<p>", x, "</p>", F.when(k % 3 == 2, say("after ", k.cast("string"), " ")).otherwise("")))
    body = say("<body><section epub:type='chapter ", F.col("source"), "'><h1>Part <b>", F.col("doc_id").cast("string"), "</b></h1>", F.array_join(paragraphs, ""), "<ul><li>first &amp; only</li><li> </li></ul></section></body></html>")
    return say(head, body)


_PARAGRAPHS_SQL = "array_to_string(list_transform(lines, lambda x, k: '<p>' || x || '</p>' || CASE WHEN k % 3 = 0 THEN 'after ' || (k - 1) || ' ' ELSE '' END), '')"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, member, content of one package for each book of documents.

    The manifest lists documents by id, a style sheet and one document twice; two in three are in the spine,
    and every seventh is navigation.
    """
    docs = _docs(spark, sf_dir)
    name = F.col("doc_id").cast("string")
    item = say("<item id='i", name, "' href='text/d", name, ".xhtml#top' media-type='application/xhtml+xml'", F.when(F.col("doc_id") % 7 == 0, " properties='nav  scripted'").otherwise(""), "/>")
    ref = F.when(F.col("doc_id") % 3 != 0, say("<itemref idref='i", name, "'/>"))
    lists = docs.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item"), ref.alias("ref")))).alias("x"))
    opf = say("<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='css' href='s.css' media-type='text/css'/>", F.array_join(F.transform("x", lambda v: v["item"]), ""), "</manifest><spine><itemref idref='gone'/>", F.array_join(F.filter(F.transform("x", lambda v: v["ref"]), lambda v: v.isNotNull()), ""), "</spine></package>")
    fixed = F.array(F.struct(F.lit("mimetype").alias("member"), F.lit("application/epub+zip").alias("content")), F.struct(F.lit("META-INF/container.xml").alias("member"), F.lit(_CONTAINER).alias("content")), F.struct(F.lit("OEBPS/content.opf").alias("member"), opf.alias("content")))
    rest = lists.select("book", F.explode(fixed).alias("m")).select("book", "m.member", "m.content")
    return rest.unionByName(docs.select("book", _path().alias("member"), _document().alias("content"))).withColumn("content", F.col("content").cast("binary"))


# ---- inspection


def inspect_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspect.inspect(books(spark, sf_dir))
    return found.select("book", F.col("pos").cast("int").alias("pos"), "path", "in_spine", "is_nav", F.array_join("properties", " ").alias("properties"), F.array_join("epub_types", " ").alias("epub_types"), "title", "sample")


_INSPECT_SQL = rf"""WITH {_DOCS_SQL},
shown AS (
  SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Part ' || doc_id ELSE 'Title ' || doc_id END AS title,
         CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Title ' || doc_id || ' ' END || 'Part ' || ' ' || doc_id || ' '
         || array_to_string(list_transform(raw, lambda x, k: x || CASE WHEN k % 3 = 0 THEN ' after ' || (k - 1) ELSE '' END), ' ') || ' first & only' AS words FROM docs)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS INTEGER) AS pos, 'OEBPS/text/d' || doc_id || '.xhtml' AS path,
       doc_id % 3 <> 0 AS in_spine, doc_id % 7 = 0 AS is_nav, CASE WHEN doc_id % 7 = 0 THEN 'nav scripted' ELSE '' END AS properties,
       array_to_string(list_sort(list_distinct(['chapter', source])), ' ') AS epub_types, title, left(trim(regexp_replace(words, '\s+', ' ', 'g')), 1000) AS sample FROM shown"""


def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inspected and cut into blocks, where every fifth names an entity that XML doesn't know."""
    broken = F.regexp_extract("member", r"/d(\d+)\.xhtml$", 1)
    text = F.col("content").cast("string")
    members = books(spark, sf_dir).withColumn("content", F.when(broken.endswith("0") | broken.endswith("5"), F.replace(text, F.lit("</ul>"), F.lit("</ul>&nbsp;"))).otherwise(text).cast("binary"))
    found = inspect.inspect_all(members).select("book", "path", F.col("error").isNull().alias("sound"), F.col("error").contains("undefined entity").alias("unknown_entity"), "title")
    docs = members.where(broken != "").select("book", F.col("member").alias("path"), "content")
    cut = fragments.parsed(docs).groupBy("book", F.col("xhtml_path").alias("path")).agg(F.count("source").alias("blocks"), F.count("error").alias("errors"))
    return found.join(cut, ["book", "path"]).select("book", "path", "sound", "unknown_entity", "title", "blocks", "errors")


_QUARANTINED_SQL = rf"""WITH {_DOCS_SQL},
sized AS (SELECT *, doc_id % 5 <> 0 AS sound, 2 + len(list_filter(raw, lambda x: regexp_matches(x, '\S'))) AS n FROM docs)
SELECT book, 'OEBPS/text/d' || doc_id || '.xhtml' AS path, sound, CASE WHEN NOT sound THEN true END AS unknown_entity,
       CASE WHEN NOT sound THEN '' WHEN doc_id % 2 = 0 THEN 'Part ' || doc_id ELSE 'Title ' || doc_id END AS title,
       CASE WHEN sound THEN n ELSE 0 END AS blocks, CASE WHEN sound THEN 0 ELSE 1 END AS errors FROM sized"""


def sampled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spaced documents of the spine of each book."""
    found = inspect.inspect(books(spark, sf_dir)).select("book", "pos", "path", "in_spine")
    return sampling.sample_documents(found, found.where("in_spine").select("path"), 4).select("book", "path")


_SAMPLED_SQL = f"""WITH {_DOCS_SQL},
n AS (SELECT book, doc_id, count(*) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS k FROM docs WHERE doc_id % 3 <> 0)
SELECT book, 'OEBPS/text/d' || doc_id || '.xhtml' AS path FROM n WHERE n <= 4 OR k IN (SELECT CAST(round_even(i * (n - 1) / 3.0, 0) AS INTEGER) FROM (SELECT unnest([0, 1, 2, 3]) AS i))"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page's title and heading as a document; of every third page the title is blank."""
    kept = F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), "[^A-Za-z0-9 ]+", " ")
    xml = say(f"<html xmlns='{_XHTML}'><head><title>", F.when(F.col("page_id") % 3 == 0, "  ").otherwise(kept), "</title></head><body><h2>Page <i>", F.col("page_id").cast("string"), "</i></h2></body></html>")
    return C._table(spark, sf_dir, "pages").select("page_id", inspect.title(inspect.as_xml(xml.cast("binary"))).alias("title"))


_PAGE_TITLES_SQL = r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 OR trim(kept) = '' THEN 'Page ' || page_id ELSE left(trim(regexp_replace(kept, '\s+', ' ', 'g')), 240) END AS title
FROM (SELECT page_id, regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 'is'), '[^A-Za-z0-9 ]+', ' ', 'g') AS kept FROM pages)"""


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dots, from a folder of one step; those that leave the root are null."""
    rows = C._table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("../x/", "./x/./y/", "../../x/", "x//y/../"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("up"))
    return rows.select("c_custkey", inspect.resolve(F.lit("OEBPS"), say(F.col("up"), "d", F.col("c_custkey").cast("string"))).alias("path"))


# ---- fragments


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir).select("book", _path().alias("path"), _document().cast("binary").alias("content"))
    return docs, fragments.extract(docs)


def extracted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents as jobs of a run for each book, some of which had jobs before."""
    docs, blocks = _blocks(spark, sf_dir)
    new = blocks.select(F.col("book").alias("run_id"), "xhtml_path", "locator", "source")
    kinds = {n: t for n, t in (x.split() for x in ("run_id string", "id bigint", "xhtml_path string", "locator array<int>", "source string", "result string", "state string", "worker_id string", "lease_token string", "lease_until bigint", "attempts int", "error string"))}
    old = docs.select("book").distinct().where("book like '%1-0'").select(*[{"run_id": F.col("book"), "id": F.lit(5), "xhtml_path": F.lit("old"), "state": F.lit(S.DONE), "attempts": F.lit(1)}.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    made = queue.add_jobs(old, new)
    return made.select("run_id", "id", "xhtml_path", X.locator_text(F.col("locator")).alias("locator"), "source", "state", "attempts")


_EXTRACTED_SQL = rf"""WITH {_DOCS_SQL},
lines AS (SELECT book, doc_id, unnest(raw) AS x, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM docs),
blocks AS (
  SELECT book, doc_id, [1, 0, 0] AS place, '<h1 xmlns="{_XHTML}">Part <b>' || doc_id || '</b></h1>' AS source FROM docs
  UNION ALL SELECT book, doc_id, [1, 0, CAST(k AS INTEGER)], '<p xmlns="{_XHTML}">' || line || '</p>' FROM lines WHERE regexp_matches(x, '\S')
  UNION ALL SELECT book, doc_id, [1, 0, CAST(len(lines) + 1 AS INTEGER), 0], '<li xmlns="{_XHTML}">first &amp; only</li>' FROM docs)
SELECT book AS run_id, row_number() OVER (PARTITION BY book ORDER BY 'OEBPS/text/d' || doc_id || '.xhtml', place) + CASE WHEN book LIKE '%1-0' THEN 5 ELSE 0 END AS id, 'OEBPS/text/d' || doc_id || '.xhtml' AS xhtml_path,
       array_to_string(place, '/') AS locator, source, 'pending' AS state, 0 AS attempts FROM blocks
UNION ALL SELECT DISTINCT book, 5, 'old', NULL, NULL, 'done', 1 FROM docs WHERE book LIKE '%1-0'"""


def reassembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose paragraphs begin with a plus sign and whose first list item is replaced; read again as text."""
    docs, blocks = _blocks(spark, sf_dir)
    name = F.regexp_extract("source", r"^<(\w+)", 1)
    inner = F.regexp_extract("source", r"(?s)^<\w+[^>]*>(.*)</\w+>$", 1)
    made = F.when(name == "p", say(f"<p xmlns='{_XHTML}'>+", inner, "</p>")).when(name == "li", say(f"<li xmlns='{_XHTML}'>item</li>"))
    results = blocks.withColumn("result", made).where("result is not null").select("book", "xhtml_path", "locator", "result")
    xml = inspect.as_xml(F.col("content"))
    texts = lambda path: F.array_join(F.xpath(xml, F.lit(path)), "|")
    read = fragments.reassemble(docs, results, "vi")
    return read.select("book", "path", F.xpath_string(xml, F.lit("/*/@lang")).alias("lang"), F.xpath_string(xml, F.lit("/*/@*[name()='xml:lang']")).alias("xml_lang"), texts("//*[local-name()='p']/text()").alias("p"), texts("//*[local-name()='section']/text()").alias("after"), texts("//*[local-name()='li']/text()").alias("items"), F.xpath_int(xml, F.lit("count(//*)")).alias("elements"))


_REASSEMBLED_SQL = rf"""WITH {_DOCS_SQL}
SELECT book, 'OEBPS/text/d' || doc_id || '.xhtml' AS path, 'vi' AS lang, 'vi' AS xml_lang,
       array_to_string(list_transform(list_filter(raw, lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '\S') THEN '+' ELSE '' END || x), '|') AS p,
       array_to_string(list_transform(list_filter(generate_series(1, len(raw)), lambda k: k % 3 = 0), lambda k: 'after ' || (k - 1) || ' '), '|') AS after,
       'item| ' AS items, CAST(10 + len(raw) AS INTEGER) AS elements FROM docs"""


def _teil(markup: str) -> str:
    """A translator that refuses what has an "an" in it."""
    if "an" in markup:
        raise RuntimeError("refused")
    return markup.replace("Part ", "Teil ")


def translation_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all books prepared, three blocks of each claimed, translated, and completed or failed."""
    _, blocks = _blocks(spark, sf_dir)
    none = spark.createDataFrame([], S.JOBS)
    jobs = scratch.staged(queue.add_jobs(none, blocks.withColumnRenamed("book", "run_id")), "jobs")
    config = F.struct(*[F.lit(None).cast(k).alias(n) for n, k in S.CONFIG_FIELDS.items()])
    runs = queue.create_run(spark.createDataFrame([], S.RUNS), scratch.staged(jobs.select("run_id").distinct(), "run-ids").select("run_id", config.alias("config")), C.NOW)
    waiting = runs.select("run_id", F.explode(F.array(*map(F.lit, range(3)))).alias("turn")).select("run_id", say("worker", F.col("turn").cast("string")).alias("worker_id"), "turn")
    jobs, claims = queue.claim(jobs, runs, waiting, C.NOW, 3)
    answers = scratch.staged(translate.translated(claims, _teil, tries=2, pause=0.0), "answers")
    return translate.settled(jobs, answers).select("run_id", "id", X.locator_text(F.col("locator")).alias("locator"), "state", "result", "error", "attempts")


_JOBS_OF_BOOKS_SQL = _EXTRACTED_SQL[: _EXTRACTED_SQL.index("UNION ALL SELECT DISTINCT")].replace("+ CASE WHEN book LIKE '%1-0' THEN 5 ELSE 0 END", "")
_ROUND_SQL = f"""WITH j AS ({_JOBS_OF_BOOKS_SQL})
SELECT run_id, id, locator, CASE WHEN id > 3 THEN 'pending' WHEN contains(source, 'an') THEN 'failed' ELSE 'done' END AS state,
       CASE WHEN id <= 3 AND NOT contains(source, 'an') THEN replace(source, 'Part ', 'Teil ') END AS result,
       CASE WHEN id <= 3 AND contains(source, 'an') THEN 'translator: refused' END AS error, CAST(id <= 3 AS INTEGER) AS attempts FROM j"""


def merged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose paragraphs are all replaced, written as archives, verified and read again."""
    docs, blocks = _blocks(spark, sf_dir)
    inner = F.regexp_extract("source", r"(?s)^<p[^>]*>(.*)</p>$", 1)
    results = blocks.where("source like '<p%'").select("book", "xhtml_path", "locator", say(f"<p xmlns='{_XHTML}'>+", inner, "</p>").alias("result"))
    merged = fragments.reassemble(docs, results, "vi").select("book", F.col("path").alias("member"), "content", "error")
    whole = books(spark, sf_dir).where("member not like 'OEBPS/text/%'").withColumn("error", F.lit(None).cast("string")).unionByName(merged)
    whole = scratch.staged(whole, "members")  # written, and its names looked at twice
    folder, names = scratch.folder(spark, "merged"), whole.select(say(F.col("book"), ".epub").alias("name"), "member", "error")
    archive.write_archives(whole.withColumn("book", say(F.col("book"), ".epub")), folder)
    sound = archive.verified_files(spark, folder, names).select(F.col("book").alias("name"), F.col("error").isNull().alias("sound"))
    read = archive.scan(spark, folder).groupBy(F.element_at(F.split("book", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("content").cast("long")).alias("n_bytes"))
    return sound.join(read, "name").join(names.groupBy("name").agg(F.count("error").alias("errors")), "name")


def structure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block keeps its structure when its text changes, and when in every second turn a tag, else an attribute's order does."""
    turns = C._table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    block = lambda tag, attributes: say("<", tag, attributes, ">x<b/>y</", tag, ">")
    one, two = say(" class='", F.col("role"), "' id='q'"), say(" id='q' class='", F.col("role"), "'")
    tag = F.when(F.col("turn") % 2 == 0, "p").otherwise("h1")
    c = turns.select("conv_id", "turn", block(F.lit("p"), one).alias("source"), F.replace(block(F.lit("p"), one), F.lit(">x<"), F.lit(">changed<")).alias("same"), block(tag, two).alias("other"))
    made = fragments.signed(c, {"s": "source", "t": "same", "u": "other"})
    return made.select("conv_id", "turn", (F.col("s") == F.col("t")).alias("kept"), (F.col("s") == F.col("u")).alias("kept_other"))


def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks with up to three page breaks: protected, the first marker lost where conv_id divides by five, restored and checked."""
    head = f"<p xmlns='{_XHTML}' xmlns:epub='{_OPS}'>"
    rows = C._table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", say(head, F.repeat(F.lit("word<span epub:type='pagebreak'/>"), (F.col("turn") % 4).cast("int")), "end</p>").alias("source"))
    ready = fragments.protected(rows).withColumn("translated", F.when(F.col("id") % 5 == 0, F.replace("protected", say("[[KEEP_PAGEBREAK_", F.col("id").cast("string"), "_0]]"), F.lit(""))).otherwise(F.col("protected")))
    checked = fragments.checked(ready.select("id", "turn", "source", "translated", F.size("markers").alias("markers"), X.count_of(F.col("protected"), F.lit("[[KEEP_PAGEBREAK_")).alias("found")))
    return checked.select(F.col("id").alias("conv_id"), "turn", "markers", "found", "error", X.count_of(F.col("result"), F.lit("pagebreak")).alias("restored"))


# ---- archives


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all books, written by the data source, listed, verified against their members, and read again."""
    rows, folder = books(spark, sf_dir), scratch.folder(spark, "books")
    archive.write_archives(rows.withColumn("book", say(F.col("book"), ".epub")), folder)
    listed = archive.list_books(spark, folder).select("name")
    expected = rows.select(say(F.col("book"), ".epub").alias("name"), "member")
    sound = archive.verified_files(spark, folder, expected).select(F.col("book").alias("name"), "error")
    read = archive.scan(spark, folder).groupBy(F.element_at(F.split("book", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("content").cast("long")).alias("n_bytes"), F.max(F.when(F.col("ordinal") == 0, F.col("member"))).alias("first"))
    return listed.join(sound, "name").join(read, "name").select("name", "members", "n_bytes", "first", F.col("error").isNull().alias("sound"))


_FILES_SQL = rf"""WITH {_DOCS_SQL},
sizes AS (
  SELECT book, length('<item id=''i' || doc_id || ''' href=''text/d' || doc_id || '.xhtml#top'' media-type=''application/xhtml+xml''' || CASE WHEN doc_id % 7 = 0 THEN ' properties=''nav  scripted''' ELSE '' END || '/>')
         + CASE WHEN doc_id % 3 <> 0 THEN length('<itemref idref=''i' || doc_id || '''/>') ELSE 0 END
         + strlen('<html xmlns=''{_XHTML}'' xmlns:epub=''{_OPS}''><head><title>' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Title ' || doc_id END || '</title></head>')
         + strlen('<body><section epub:type=''chapter ' || source || '''><h1>Part <b>' || doc_id || '</b></h1>' || {_PARAGRAPHS_SQL} || '<ul><li>first &amp; only</li><li> </li></ul></section></body></html>') AS n FROM docs)
SELECT book || '.epub' AS name, count(*) + 3 AS members, CAST(sum(n) + 20 + {len(_CONTAINER)} + {len("<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='css' href='s.css' media-type='text/css'/></manifest><spine><itemref idref='gone'/></spine></package>")} AS BIGINT) AS n_bytes,
       'mimetype' AS first, true AS sound FROM sizes GROUP BY book"""


_MERGED_SQL = _FILES_SQL.replace("AS n FROM docs)", r"""+ CASE WHEN len(list_filter(raw, lambda x: regexp_matches(x, '\S'))) > 0 THEN len(list_filter(raw, lambda x: regexp_matches(x, '\S'))) + 24 ELSE 0 END AS n FROM docs)""").replace("'mimetype' AS first, true AS sound", "0 AS errors, true AS sound")


# ---- runs and jobs


def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = C.runs(spark, sf_dir).select("run_id", queue.attempts_limit().alias("_limit"))
    return C.jobs(spark, sf_dir).join(limits, "run_id").select("run_id", "id", F.coalesce(queue.claimable(C.NOW, F.col("_limit")), F.lit(False)).alias("free"))


def _run_rows(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "state", "cancel_requested", "merge_state", "merge_worker_id", "updated_at", "output_path", "error")


_RUNS_SQL = f"""
runs AS (SELECT DISTINCT 'r' || CAST(user_id % {C.RUNS} AS VARCHAR) AS run_id, 'running' AS state, CAST({C.NOW} AS BIGINT) AS updated_at FROM events)"""


def cancelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = queue.request_cancel(C.runs(spark, sf_dir), "r1", C.NOW + 1)
    return _run_rows(queue.clear_cancel(queue.mark_failed(runs, "r3", "e" * 5000, C.NOW + 2), "r3", C.NOW + 3))


def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = queue.update_run(C.runs(spark, sf_dir), "r2", C.NOW + 1, merge_state=S.LEASED, output_path="/o")
    return _run_rows(queue.mark_failed(queue.mark_failed(runs, "r2", "broken", C.NOW + 2), "r4", "x" * 4001, C.NOW + 3))


def retried_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = queue.update_run(queue.mark_failed(C.runs(spark, sf_dir), "r1", "broken", C.NOW + 1), "r2", C.NOW + 1, merge_state=S.COMPLETED)
    jobs = C.jobs(spark, sf_dir)
    _, runs, first = queue.retry_failed(jobs, runs, "r1", C.NOW + 2)
    _, runs, second = queue.retry_failed(jobs, runs, "r2", C.NOW + 3, [7, 8, 9, 10, 11, 12])
    return _run_rows(runs).withColumn("reset", F.when(F.col("run_id") == "r1", first).when(F.col("run_id") == "r2", second).otherwise(0).cast("long"))


def merge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs r0, r3 and r4 have all jobs done; r3 is cancelled; two workers ask for each."""
    jobs = C.jobs(spark, sf_dir).withColumn("state", F.when(F.col("run_id").isin("r0", "r3", "r4"), S.DONE).otherwise(F.col("state")))
    _, outcome = queue.try_claim_merge(jobs, C.runs(spark, sf_dir), C._waiting(spark, sf_dir, 2), C.NOW + 9)
    return outcome


def created_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New runs beside those that are there, one with a limit and one without; their settings."""
    fields = {"max_attempts": F.when(F.col("n") == 1, 7), "model": F.lit("m"), "selected_paths": F.array(F.lit("a"), F.lit("b"))}
    new = spark.range(2).select(F.col("id").alias("n")).select(say("new", F.col("n").cast("string")).alias("run_id"), F.struct(*[fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in S.CONFIG_FIELDS.items()]).alias("config"))
    runs = queue.create_run(C.runs(spark, sf_dir), new, C.NOW + 5)
    return runs.select("run_id", "state", "merge_state", "started_at", "cancel_requested", queue.attempts_limit().alias("max_attempts"), F.col("config.model").alias("model"))


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.config(C.runs(spark, sf_dir), "r2").select("model", "max_attempts", "workers")


def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = C.jobs(spark, sf_dir)
    first = jobs.groupBy("run_id").agg(F.min("id").alias("id")).orderBy("run_id").first()
    return queue.job(jobs, first["run_id"], first["id"]).select("run_id", "id", "state", "attempts", X.locator_text(F.col("locator")).alias("locator"))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary_json(summary.summary(C.jobs(spark, sf_dir), C.runs(spark, sf_dir)))


def progress_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every state that a run's progress tells apart."""
    k = F.col("e.event_id") % 5
    e = C._table(spark, sf_dir, "events").alias("e").select("event_id", F.when(k == 0, "completed").when(k == 1, "failed").otherwise("running").alias("state"), F.when(k == 3, S.LEASED).otherwise(S.PENDING).alias("merge_state"), (k == 2).alias("cancel_requested"), F.lit(9).alias("total"), (F.col("event_id") % 9).alias("done"), (F.col("event_id") % 3).alias("leased"), (F.col("event_id") % 4).alias("failed"), (C.NOW - F.col("event_id") % 5000).alias("started_at"))
    return e.select("event_id", X.progress_line(F.lit(C.NOW * 1000)).alias("line"))


_PROGRESS_SQL = f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'EPUB complete · ' || ratio WHEN 1 THEN 'EPUB needs retry · ' || ratio || ' · ' || event_id % 4 || ' failed' WHEN 2 THEN 'EPUB cancellation requested · ' || ratio
       WHEN 3 THEN 'EPUB merging · ' || ratio ELSE 'EPUB translating · ' || ratio || ' complete · ' || event_id % 3 || ' active · ' || event_id % 4 || ' failed · ' || {C._ELAPSED_SQL} END AS line
FROM (SELECT event_id, event_id % 9 || '/9' AS ratio, event_id % 5000 AS s FROM events)"""


# ---- names, models and scope


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C._table(spark, sf_dir, "part").withColumn("shown", F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_name")))
    reasoning = F.when(F.col("p_size") % 4 != 3, F.col("p_size") % 4 == 0)
    scoped = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).when(F.col("p_size") % 3 == 0, F.array().cast("array<string>"))
    return p.select("p_partkey", X.model_identifier(F.col("p_brand"), F.col("p_type")).alias("model"), X.model_label(F.col("p_brand"), F.col("p_type"), F.col("shown")).alias("label"), F.array_join(X.thinking_levels(reasoning), " ").alias("levels"), F.array_join(X.preferred(scoped, F.array("p_brand")), " ").alias("offered"))


def chosen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model behind a label that is shown to a customer; every third label belongs to none."""
    models = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(i).alias("id"), F.lit(n).cast("string").alias("name")) for p, i, n in (("a", "x", "Ax"), ("b", "y", None), ("b", "z", ""), ("c", "x", "Ax"))])
    label = F.element_at(F.array(F.lit("Ax (c/x)"), F.lit("b/z"), F.lit("Ax")), (F.col("c_custkey") % 3 + 1).cast("int"))
    found = C._table(spark, sf_dir, "customer").withColumn("m", X.model_at(label, models))
    return found.select("c_custkey", "m.provider", "m.id", "m.name")


def resolved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run a request means: of every fourth one that is named, of every third else the current one, else the last one."""
    stored = C._table(spark, sf_dir, "nation").select(say("n", F.col("n_nationkey").cast("string")).alias("run"), (F.col("n_nationkey") * 7 % 25).alias("modified"))
    k = F.col("c_custkey")
    name = F.when(k % 8 == 0, "elsewhere").when(k % 4 == 0, F.lit("run"))
    asked = C._table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 8 == 4, F.lit("n3")).otherwise(name).alias("explicit"), F.when(k % 3 == 0, "now").alias("current"))
    return scope.resolve_runs(asked.withColumn("explicit", F.when(F.col("explicit") != "run", F.col("explicit"))), stored).select("c_custkey", "run", "error")


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case folding and digits of a few odd spellings."""
    odd = F.element_at(F.array(*map(F.lit, ("STRASSE Straße", "ΟΔΟΣ", "ﬁN ŉ", "²③", "١٢", "½", "plain 7"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    return C._table(spark, sf_dir, "customer").select("c_custkey", X.casefold(odd).alias("folded"), X.all_digits(odd).alias("digits"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("/books/A.b.epub"), F.lit("notes"), F.lit("x/.hidden"), F.lit("dir.d/Z.EPUB")), (F.col("page_id") % 4 + 1).cast("int"))
    return C._table(spark, sf_dir, "pages").withColumn("p", path).select("page_id", X.stem(F.col("p")).alias("stem"), X.extension(F.col("p")).alias("extension"), X.run_path(say("/runs/", F.col("page_id").cast("string")), F.col("p")).alias("path"))


def glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of every conversation's turns; blank sources drop out, every second entry has a note."""
    entry = F.struct("turn", F.when(F.col("turn") % 3 == 2, " ").otherwise(say(" ", F.col("role"), F.col("turn").cast("string"))).alias("source"), F.when(F.col("conv_id") % 4 != 0, say("T", F.col("turn").cast("string"), " ")).alias("target"), F.when(F.col("turn") % 2 == 0, F.lit(" n ")).alias("note"))
    by = C._table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return by.select("conv_id", X.glossary_text(F.col("e")).alias("text"))


def scope_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's scope in a review, and the outcome of an edit that names an unknown path in some."""
    labels = C._table(spark, sf_dir, "labels")
    docs = C._table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("pos"), F.coalesce("lang", F.lit("none")).alias("lang"), (F.col("doc_id") % 3 == 0).alias("in_spine"), F.lit(False).alias("is_nav"))
    pick = lambda c: labels.where(c).select(F.col("doc_id").cast("string").alias("path"))
    lists = scope.scope_lists(scope.assign_scope(docs, pick("toxic = 1"), pick("quality = 1")), "lang")
    known = F.concat("translate", "keep")
    edit = say(" ", F.col("keep")[0], "\r\n\n", F.when(F.col("lang") == "en", "nowhere").otherwise(F.col("keep")[1]), "\n", F.col("keep")[0])
    made = lists.where("size(keep) > 1").withColumn("edit", edit)
    return made.select("lang", scope.scope_summary(F.col("lang"), F.upper("lang"), F.col("translate"), F.col("keep")).alias("review"), F.array_join(F.slice(scope.edited_scope(F.col("edit"), known, F.col("translate")), 1, 9), ",").alias("edited"), scope.first_unknown(F.col("edit"), known).alias("unknown"))


_SCOPE_SQL = """WITH s AS (
  SELECT coalesce(lang, 'none') AS lang, doc_id, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 't' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'k' WHEN doc_id % 3 = 0 THEN 't' ELSE 'k' END AS side FROM documents),
l AS (SELECT lang, coalesce(list(path ORDER BY doc_id) FILTER (side = 't'), []) AS t, coalesce(list(path ORDER BY doc_id) FILTER (side = 'k'), []) AS k FROM s GROUP BY lang),
v AS (SELECT *, list_transform([t, k], lambda x: CASE WHEN len(x) = 0 THEN 'none' ELSE array_to_string(x[1:5], ', ') || CASE WHEN len(x) > 5 THEN ', +' || (len(x) - 5) || ' more' ELSE '' END END) AS shown FROM l WHERE len(k) > 1)
SELECT lang, 'Target: ' || lang || ' (' || upper(lang) || ')' || chr(10) || 'Translate ' || len(t) || ': ' || shown[1] || chr(10) || 'Keep ' || len(k) || ': ' || shown[2] || chr(10) || 'AI classified ' || (len(t) + len(k)) || ' XHTML documents; scope can be edited as one list.' AS review,
       CASE WHEN lang = 'en' THEN array_to_string(t[1:9], ',') ELSE k[1] || ',' || k[2] END AS edited, CASE WHEN lang = 'en' THEN 'nowhere' END AS unknown FROM v"""


def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.array(F.lit("04"), F.lit("+3"), F.lit("12"), F.lit(""), F.lit("0"), F.lit("7")), (F.col("event_id") % 6 + 1).cast("int"))
    return C._table(spark, sf_dir, "events").select("event_id", X.worker_count(given).alias("workers"))


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators to numbers and back, and whether one stands before 10/2 by number."""
    text = F.when(F.col("turn") == 0, "").otherwise(say((F.col("conv_id") % 13).cast("string"), "/", F.col("turn").cast("string")))
    place = X.locator(text)
    return C._table(spark, sf_dir, "conversations").select("conv_id", "turn", X.locator_text(place).alias("locator"), F.size(place).alias("n"), (place < F.array(F.lit(10), F.lit(2))).alias("before"))


# ---- the same functions over the tables' own values


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts case-folded, and how many of their tokens are numbers."""
    text = F.coalesce("text", F.lit(""))
    return C._table(spark, sf_dir, "documents").select("doc_id", F.md5(X.casefold(text).cast("binary")).alias("folded"), F.size(F.filter(X.tokens(text), X.all_digits)).alias("numbers"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, extension and run path of each page's address: its host, its path, or both as one relative path."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    k = F.col("page_id") % 3
    path = F.when(k == 0, F.regexp_extract(bare, "^[^/]+", 0)).when(k == 1, F.regexp_extract(bare, "/.*$", 0)).otherwise(bare)
    return C._table(spark, sf_dir, "pages").withColumn("p", F.rtrim(path, F.lit("/"))).select("page_id", X.stem(F.col("p")).alias("stem"), X.extension(F.col("p")).alias("extension"), X.run_path(F.lit("/runs/7"), F.col("p")).alias("path"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path as a reference from a folder, with up to three steps up; null where it leaves the root."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1), "/$", "")
    lang = F.regexp_extract(path, "^/([^/]*)", 1)
    href = say(F.repeat(F.lit("../"), (F.col("page_id") % 4).cast("int")), "./text", path, "/")
    return C._table(spark, sf_dir, "pages").select("page_id", inspect.resolve(say("OEBPS/", lang), href).alias("path"))


def event_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in an event's properties as a count of workers, with a leading zero or its type before it in some."""
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_type") == "error", say(F.col("event_type"), k)).when(F.col("event_type") == "click", say("0", k)).otherwise(k)
    return C._table(spark, sf_dir, "events").select("event_id", X.worker_count(given).alias("workers"))


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each part's label names among the twenty of its shelf; several may share a label."""
    p = C._table(spark, sf_dir, "part").withColumn("shelf", F.floor(F.col("p_partkey") / 20)).withColumn("shown", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")))
    model = F.struct(F.col("p_brand").alias("provider"), F.col("p_type").alias("id"), F.col("shown").alias("name"), "p_partkey")
    shelves = p.groupBy("shelf").agg(F.array_sort(F.collect_list(F.struct("p_partkey", model.alias("m")))).alias("x")).select("shelf", F.transform("x", lambda v: v["m"]).alias("models"))
    label = X.model_label(F.col("p_brand"), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    return p.join(shelves, "shelf").withColumn("m", X.model_at(label, F.col("models"))).select("p_partkey", label.alias("label"), F.col("m.p_partkey").alias("chosen"), "m.name")


_URL_PARTS_SQL = r"""
WITH p AS (SELECT page_id, rtrim(CASE page_id % 3 WHEN 0 THEN split_part(bare, '/', 1) WHEN 1 THEN substr(bare, instr(bare || '/', '/')) ELSE bare END, '/') AS p
           FROM (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS bare FROM pages)),
l AS (SELECT page_id, p, split_part(p, '/', -1) AS x, string_split(split_part(p, '/', -1), '.') AS d FROM p)
SELECT page_id, CASE WHEN len(d) > 1 THEN array_to_string(d[:-2], '.') ELSE x END AS stem, CASE WHEN len(d) > 1 THEN '.' || d[-1] ELSE '' END AS extension,
       CASE WHEN p LIKE '/%' THEN p ELSE '/runs/7/' || p END AS path FROM l"""
_PAGE_PATHS_SQL = r"""
WITH p AS (SELECT page_id, rtrim(substr(bare, instr(bare || '/', '/')), '/') AS path FROM (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS bare FROM pages))
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OEBPS/' || split_part(path, '/', 2) || '/text' WHEN 1 THEN 'OEBPS/text' WHEN 2 THEN 'text' END || path AS path FROM p"""
_PART_MODELS_SQL = r"""
WITH p AS (SELECT *, p_partkey // 20 AS shelf, p_brand || '/' || p_type AS base, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS shown FROM part),
l AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (' || base || ')' ELSE base END AS label, coalesce(shown || ' (' || base || ')', base) AS own FROM p)
SELECT a.p_partkey, a.label, min(b.p_partkey) AS chosen, arg_min(b.shown, b.p_partkey) FILTER (b.p_partkey IS NOT NULL) AS name
FROM l a LEFT JOIN l b ON a.shelf = b.shelf AND a.label = b.own GROUP BY a.p_partkey, a.label"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (inspect_books, quarantined_documents, sampled_books, page_titles, resolved_paths, extracted_jobs, reassembled_documents, translation_round, merged_books, structure_checks, page_breaks, archive_files, claimable_jobs, cancelled_runs, failed_runs, retried_runs, merge_claims, created_runs, run_settings, job_lookup, summary_lines, progress_states, model_names, chosen_models, resolved_runs, folded_names, path_parts, glossaries, scope_reviews, worker_counts, locators, folded_texts, url_parts, page_paths, event_workers, part_models)
}

_CANCEL_SQL = "run_id = 'r3'"
ORACLES: dict[str, str] = {
    "inspect_books": _INSPECT_SQL,
    "quarantined_documents": _QUARANTINED_SQL,
    "sampled_books": _SAMPLED_SQL,
    "page_titles": _PAGE_TITLES_SQL,
    "resolved_paths": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'x/d' || c_custkey WHEN 1 THEN 'OEBPS/x/y/d' || c_custkey WHEN 3 THEN 'OEBPS/x/d' || c_custkey END AS path FROM customer",
    "extracted_jobs": _EXTRACTED_SQL,
    "reassembled_documents": _REASSEMBLED_SQL,
    "translation_round": _ROUND_SQL,
    "merged_books": _MERGED_SQL,
    "structure_checks": "SELECT conv_id, turn, true AS kept, turn % 2 = 0 AS kept_other FROM conversations",
    "page_breaks": """
SELECT conv_id, turn, CAST(turn % 4 AS INTEGER) AS markers, CAST(turn % 4 AS INTEGER) AS found, CASE WHEN lost THEN 'pagebreak marker changed' END AS error, CASE WHEN NOT lost THEN CAST(turn % 4 AS INTEGER) END AS restored
FROM (SELECT *, conv_id % 5 = 0 AND turn % 4 > 0 AS lost FROM conversations)""",
    "archive_files": _FILES_SQL,
    "claimable_jobs": f"WITH {C._JOBS_SQL} SELECT run_id, id, {C._FREE_SQL} AS free FROM jobs",
    "cancelled_runs": f"""WITH {_RUNS_SQL}
SELECT run_id, state, run_id = 'r1' AS cancel_requested, CASE run_id WHEN 'r3' THEN 'failed' ELSE 'pending' END AS merge_state, CAST(NULL AS VARCHAR) AS merge_worker_id,
       updated_at + CASE run_id WHEN 'r1' THEN 1 WHEN 'r3' THEN 3 ELSE 0 END AS updated_at, CAST(NULL AS VARCHAR) AS output_path, CAST(NULL AS VARCHAR) AS error FROM runs""",
    "failed_runs": f"""WITH {_RUNS_SQL}
SELECT run_id, CASE WHEN run_id IN ('r2', 'r4') THEN 'failed' ELSE state END AS state, {_CANCEL_SQL} AS cancel_requested, CASE run_id WHEN 'r2' THEN 'leased' WHEN 'r4' THEN 'failed' ELSE 'pending' END AS merge_state, CAST(NULL AS VARCHAR) AS merge_worker_id,
       updated_at + CASE run_id WHEN 'r2' THEN 2 WHEN 'r4' THEN 3 ELSE 0 END AS updated_at, CASE run_id WHEN 'r2' THEN '/o' END AS output_path, CASE run_id WHEN 'r2' THEN 'broken' WHEN 'r4' THEN repeat('x', 4000) END AS error FROM runs""",
    "retried_runs": f"""WITH {_RUNS_SQL}, {C._JOBS_SQL.strip()}
SELECT run_id, state, {_CANCEL_SQL} AS cancel_requested, CASE run_id WHEN 'r2' THEN 'completed' ELSE 'pending' END AS merge_state, CAST(NULL AS VARCHAR) AS merge_worker_id, updated_at + CASE run_id WHEN 'r1' THEN 2 WHEN 'r2' THEN 3 ELSE 0 END AS updated_at,
       CAST(NULL AS VARCHAR) AS output_path, CAST(NULL AS VARCHAR) AS error, CASE run_id WHEN 'r1' THEN (SELECT count(*) FROM jobs WHERE run_id = 'r1' AND state = 'failed') WHEN 'r2' THEN (SELECT count(*) FROM jobs WHERE run_id = 'r2' AND state = 'failed' AND id BETWEEN 7 AND 12) ELSE 0 END AS reset FROM runs""",
    "merge_claims": f"WITH {_RUNS_SQL} SELECT run_id, 'worker' || k AS worker_id, run_id IN ('r0', 'r4') AND k = 0 AS accepted FROM runs, (SELECT unnest([0, 1]) AS k)",
    "created_runs": f"""WITH {_RUNS_SQL}
SELECT run_id, state, 'pending' AS merge_state, CAST({C.NOW - 3725} AS BIGINT) AS started_at, {_CANCEL_SQL} AS cancel_requested, {C._LIMIT_SQL} AS max_attempts, 'test/' || run_id AS model FROM runs
UNION ALL SELECT 'new' || k, 'running', 'pending', {C.NOW + 5}, false, CASE k WHEN 1 THEN 7 ELSE 3 END, 'm' FROM (SELECT unnest([0, 1]) AS k)""",
    "run_settings": "SELECT 'test/r2' AS model, 4 AS max_attempts, 4 AS workers",
    "job_lookup": f"WITH {C._JOBS_SQL} SELECT run_id, id, state, attempts, (user_id % 11) || '/' || k AS locator FROM (SELECT j.*, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k FROM jobs j JOIN events e ON e.event_id = j.id) ORDER BY run_id, id LIMIT 1",
    "summary_lines": f"""
SELECT run_id, '{{"state":"running","mergeState":"pending","model":"test/' || run_id || '","thinking":"high","workers":' || CASE run_id WHEN 'r2' THEN 4 ELSE 1 END || ',"maxAttempts":' || {C._LIMIT_SQL} || ',"total":' || total || ',"done":' || done || ',"leased":' || leased
       || ',"failed":' || failed || ',"pending":' || pending || ',"retryable":' || retryable || ',"startedAt":{C.NOW - 3725},"cancelRequested":' || ({_CANCEL_SQL}) || ',"outputPath":null,"error":null}}' AS json FROM ({C._COUNTS_SQL})""",
    "progress_states": _PROGRESS_SQL,
    "model_names": """
SELECT p_partkey, p_brand || '/' || p_type AS model, CASE WHEN p_size % 3 = 1 AND p_name <> '' THEN p_name || ' (' || p_brand || '/' || p_type || ')' ELSE p_brand || '/' || p_type END AS label,
       CASE WHEN p_size % 4 IN (1, 2) THEN 'off' ELSE 'off minimal low medium high xhigh max' END AS levels, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS offered FROM part""",
    "chosen_models": """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'b' END AS provider, CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'z' END AS id, CASE c_custkey % 3 WHEN 0 THEN 'Ax' WHEN 1 THEN '' END AS name FROM customer""",
    "resolved_runs": """
SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 4 THEN 'n3' WHEN c_custkey % 3 = 0 THEN 'now' ELSE (SELECT 'n' || n_nationkey FROM nation ORDER BY n_nationkey * 7 % 25 DESC LIMIT 1) END AS run,
       CASE WHEN c_custkey % 8 = 0 THEN 'no run at elsewhere' END AS error FROM customer""",
    "folded_names": """
SELECT c_custkey, ['strasse strasse', 'οδοσ', 'fin ʼn', '²③', '١٢', '½', 'plain 7'][CAST(c_custkey % 7 + 1 AS INTEGER)] AS folded, c_custkey % 7 IN (3, 4) AS digits FROM customer""",
    "path_parts": """
SELECT page_id, ['A.b', 'notes', '.hidden', 'Z'][k] AS stem, ['.epub', '', '', '.EPUB'][k] AS extension, CASE WHEN k = 1 THEN '/books/A.b.epub' ELSE '/runs/' || page_id || '/' || ['', 'notes', 'x/.hidden', 'dir.d/Z.EPUB'][k] END AS path
FROM (SELECT page_id, CAST(page_id % 4 + 1 AS INTEGER) AS k FROM pages)""",
    "glossaries": """
SELECT conv_id, coalesce(string_agg(role || turn || ' = T' || turn || CASE WHEN turn % 2 = 0 THEN ' # n' ELSE '' END, chr(10) ORDER BY turn, role) FILTER (turn % 3 <> 2 AND conv_id % 4 <> 0) || chr(10), '# No fixed glossary entries were found.' || chr(10)) AS text FROM conversations GROUP BY conv_id""",
    "scope_reviews": _SCOPE_SQL,
    "worker_counts": "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 12 WHEN 5 THEN 7 END AS workers FROM events",
    "folded_texts": r"SELECT doc_id, md5(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ς', 'σ')) AS folded, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^\p{Nd}+$'))) AS INTEGER) AS numbers FROM (SELECT doc_id, text, " + C._TOKENS_SQL + " AS t FROM documents)",
    "url_parts": _URL_PARTS_SQL,
    "page_paths": _PAGE_PATHS_SQL,
    "event_workers": "SELECT event_id, CASE WHEN event_type IN ('error', 'click') OR k = 0 THEN NULL ELSE k END AS workers FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "part_models": _PART_MODELS_SQL,
    "locators": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE (conv_id % 13) || '/' || turn END AS locator, CASE WHEN turn = 0 THEN 0 ELSE 2 END AS n, turn = 0 OR conv_id % 13 < 10 OR (conv_id % 13 = 10 AND turn < 2) AS before FROM conversations",
}
