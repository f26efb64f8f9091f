"""What a packaged document holds: manifest, reading order, titles, types and text samples.

Built-in XML functions, behind one check that the text is well-formed, as those end a query where it
isn't. DOCTYPE declarations are dropped first, as an external one would be fetched. inspect_all gives
what is wrong as rows of its own beside all sound documents; inspect takes it for an error.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..scratch import staged

SAMPLE_LIMIT, TITLE_LIMIT = 1000, 240
XHTML = "application/xhtml+xml"
_PACKAGE = "manifest struct<item array<struct<_href string, _id string, `_media-type` string, _properties string>>>, spine struct<itemref array<struct<_idref string>>>"


def as_xml(content: Column) -> Column:
    text = F.regexp_replace(content.cast("string"), r"^\x{FEFF}", "")
    return F.regexp_replace(text, r"(?is)<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "")


def _complaint(text: str | None) -> str | None:
    try:
        expat.ParserCreate("utf-8", "\x1f").Parse((text or "").encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        return str(e)
    return None


def xml_error(xml: Column) -> Column:
    """Why a text is not well-formed XML; null if it is."""

    def checked(texts: pa.Array) -> pa.Array:
        return pa.array([_complaint(t) for t in texts.to_pylist()], pa.string())

    checked.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(checked, "string")(xml)


def _sound(rows: DataFrame, content: str, name: str = "xml") -> DataFrame:
    """rows with the XML of a column, null where it is malformed, and its error."""
    rows = rows.withColumn(name, as_xml(F.col(content))).withColumn(f"{name}_error", xml_error(F.col(name)))
    return rows.withColumn(name, F.when(F.col(f"{name}_error").isNull(), F.col(name)))


def _insisting(rows: DataFrame) -> DataFrame:
    """rows without errors; any error ends the query."""
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).drop("error")


def resolve(folder: Column, href: Column) -> Column:
    """href from folder with dots resolved; null if it leaves the root."""
    step = lambda s, x: F.when(s.isNull() | x.isin("", "."), s).when(x == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))).otherwise(F.concat(s, F.array(x)))
    parts = F.split(F.concat_ws("/", folder, href), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def packages_all(members: DataFrame) -> DataFrame:
    """book, path, content, error of each book's package document.

    The container names it; else it is OEBPS/content.opf; else the only .opf member. A malformed container
    names none.
    """
    container = _sound(members.where("member = 'META-INF/container.xml'").select("book", "content"), "content")
    named = container.select("book", F.nullif(F.xpath_string("xml", F.lit("//*[local-name()='rootfile'][@full-path != '']/@full-path")), F.lit("")).alias("named"))
    opf = members.where(F.lower("member").endswith(".opf"))
    found = opf.groupBy("book").agg(F.max(F.when(F.col("member") == "OEBPS/content.opf", F.col("member"))).alias("usual"), F.when(F.count(F.lit(1)) == 1, F.min("member")).alias("only"))
    books = members.select("book").distinct().join(named, "book", "left").join(found, "book", "left")
    chosen = books.select("book", F.coalesce("named", "usual", "only").alias("member"))
    read = chosen.join(members.select("book", "member", "content"), ["book", "member"], "left")
    missing = F.when(F.col("content").isNull(), F.concat(F.lit("could not find EPUB package document of "), F.col("book")))
    checked = read.withColumn("complaint", xml_error(F.when(F.col("content").isNotNull(), as_xml(F.col("content"))).otherwise("<none/>")))
    return checked.select("book", F.col("member").alias("path"), "content", F.coalesce(missing, "complaint").alias("error"))


def packages(members: DataFrame) -> DataFrame:
    """book, path, content of each book's package document."""
    return _insisting(packages_all(members))


def manifest_all(opf: DataFrame) -> DataFrame:
    """book, pos, id, path, properties, error of XHTML items in manifest order; of items that share an id the last, in the first's place."""
    parsed = opf.select("book", "path", F.from_xml(as_xml(F.col("content")), _PACKAGE, {"ignoreNamespace": "true"}).alias("p"))
    items = parsed.select("book", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.posexplode("p.manifest.item").alias("at", "i"))
    items = items.where(F.col("i._media-type") == XHTML)
    href = F.split(F.coalesce("i._href", F.lit("")), "#")[0]
    path = resolve(F.col("folder"), href)
    error = F.when(path.isNull(), F.concat(F.lit("manifest item escapes EPUB root: "), href))
    props = F.filter(F.split(F.coalesce("i._properties", F.lit("")), r"\s+"), lambda x: x != "")
    rows = items.select("book", "at", F.coalesce("i._id", F.lit("")).alias("id"), path.alias("path"), props.alias("properties"), error.alias("error"))
    by_id = rows.groupBy("book", "id").agg(F.min("at").alias("pos"), F.max_by(F.struct("path", "properties", "error"), "at").alias("last"))
    return by_id.select("book", "pos", "id", "last.path", "last.properties", "last.error")


def manifest(opf: DataFrame) -> DataFrame:
    return _insisting(manifest_all(opf))


def spine(opf: DataFrame) -> DataFrame:
    """book, pos, idref in reading order."""
    parsed = opf.select("book", F.from_xml(as_xml(F.col("content")), _PACKAGE, {"ignoreNamespace": "true"}).alias("p"))
    return parsed.select("book", F.posexplode("p.spine.itemref").alias("pos", "i")).select("book", "pos", F.col("i._idref").alias("idref")).where("idref is not null and idref <> ''")


def xml_text(xml: Column, path: str) -> Column:
    return F.array_join(F.xpath(xml, F.lit(path)), " ")


def title(xml: Column) -> Column:
    head = "(//*[local-name()='title' or local-name()='h1' or local-name()='h2'][normalize-space(translate(., ' ', ' ')) != ''])[1]//text()"
    return F.coalesce(X.normal_text(xml_text(xml, head), TITLE_LIMIT), F.lit(""))


def types(xml: Column) -> Column:
    """The distinct words of all attributes called type, whatever their namespace, in order."""
    words = F.flatten(F.transform(F.xpath(xml, F.lit("//@*[local-name()='type']")), lambda v: F.split(v, r"\s+")))
    return F.sort_array(F.array_distinct(F.filter(words, lambda x: x != "")))


def inspect_all(members: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """A row for each XHTML item of each book, in manifest order (pos), and for each thing that is wrong, its error.

    Wrong are books without a package document or with a malformed one, items outside the root, that aren't
    there or are malformed. among: members that hold the packages, if they can be read apart.
    """
    found = staged(packages_all(members if among is None else among), "packages")  # a row a book, needed in three places
    opf = found.where("error is null")
    items = staged(manifest_all(opf), "manifests")
    read = spine(opf).join(items.select("book", F.col("id").alias("idref"), "path"), ["book", "idref"]).select("book", "path").distinct().withColumn("_read", F.lit(True))
    docs = items.join(members.select("book", F.col("member").alias("path"), "content"), ["book", "path"], "left")
    docs = _sound(docs.withColumn("there", F.coalesce("content", F.lit("<none/>").cast("binary"))), "there")
    missing = F.when(F.col("content").isNull(), F.concat(F.lit("manifest item is not there: "), F.col("path")))
    docs = docs.withColumn("error", F.coalesce("error", missing, "xml_error")).withColumn("xml", F.when(F.col("error").isNull(), F.col("xml")))
    docs = docs.join(read, ["book", "path"], "left").withColumn("pos", F.row_number().over(W.partitionBy("book").orderBy("pos")) - 1)
    shown = docs.select("book", "pos", "path", F.col("_read").isNotNull().alias("in_spine"), F.array_contains("properties", "nav").alias("is_nav"), "properties", types(F.col("xml")).alias("epub_types"), title(F.col("xml")).alias("title"), X.normal_text(xml_text(F.col("xml"), "//text()"), SAMPLE_LIMIT).alias("sample"), "error")
    return shown.unionByName(found.where("error is not null").select("book", "path", "error"), allowMissingColumns=True)


def inspect(members: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """A row for each XHTML item of each book, in manifest order (pos); anything wrong ends the query."""
    return _insisting(inspect_all(members, among))
