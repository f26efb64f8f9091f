"""Text blocks of XHTML documents: cut out, protected, checked and put back.

Documents are read as events (see markup), in Arrow batches: a block is cut as it stands, what replaces
it goes into the same bytes, and the rest of a document stays as it was. Two things are mended on purpose: a
block is cut without the text that follows it, and what replaces it keeps that text. A document that
isn't well-formed gives a row with its error and ends nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches as B
from .markup import Reading


def protect(source: str, job_id: int) -> tuple[str, dict[str, str]]:
    """The block with a marker for each empty page break, and what the markers stand for."""
    reading, markers, edits = Reading(source), {}, []
    for span in reading.breaks:
        marker = f"[[KEEP_PAGEBREAK_{job_id}_{len(markers)}]]"
        markers[marker] = reading.piece(span)
        edits.append((span.start, span.stop, marker))
    out, at = [], 0
    for start, stop, marker in sorted(edits):
        out += [reading.data[at:start].decode(), marker]
        at = stop
    return "".join([*out, reading.data[at:].decode()]), markers


def restore(translated: str, markers: dict[str, str]) -> str:
    """Markers back to page breaks; each must be there just once."""
    for marker, page_break in markers.items():
        head, found, tail = translated.partition(marker)
        if not found or marker in tail:
            raise ValueError("pagebreak marker changed")
        translated = head + page_break + tail
    return translated


def structure(markup: str) -> str:
    """Equal for equal tags, attributes and nesting, whatever the text."""
    return Reading(markup).structure.hex()


def check(source: str | bytes, translated: str) -> None:
    """source: a block's markup, or its structure's digest."""
    if not translated.strip():
        raise ValueError("empty result")
    if (source if isinstance(source, bytes) else Reading(source).structure) != Reading(translated).structure:
        raise ValueError("structure changed")


# ---- over DataFrames


def parsed(docs: DataFrame) -> DataFrame:
    """book, xhtml_path, locator, source, error: a row for every block that isn't blank, or one error for a malformed document.

    docs: book, path, content.
    """
    kinds = pa.schema([("book", pa.string()), ("xhtml_path", pa.string()), ("locator", pa.list_(pa.int32())), ("source", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            rows: list[tuple] = []
            for row in piece.to_pylist():
                book, path = row["book"], row["path"]
                try:
                    reading = Reading(row["content"] or b"", structures=False)
                    rows += [(book, path, b.place, reading.piece(b), None) for b in reading.blocks if not b.blank]
                except (ValueError, LookupError) as e:
                    rows.append((book, path, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)], schema=kinds)

    B.bound(docs.sparkSession)
    return docs.select("book", "path", "content").mapInArrow(run, "book string, xhtml_path string, locator array<int>, source string, error string")


def extract(docs: DataFrame) -> DataFrame:
    """book, xhtml_path, locator, source of the blocks of all well-formed documents."""
    return parsed(docs).where("error is null").drop("error")


def malformed(docs: DataFrame) -> DataFrame:
    """book, xhtml_path, error of the others."""
    return parsed(docs).where("error is not null").select("book", "xhtml_path", "error")


def _mapped(rows: DataFrame, made: str, f: Callable[[dict], dict]) -> DataFrame:
    """rows with more columns, made by f; an error of a row goes to its error column."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    names, given = [x.split()[0] for x in made.split(", ")], rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches):
            found = []
            for row in batch.to_pylist():
                try:
                    found.append({"error": None, **f(row)})
                except ValueError as e:
                    found.append({"error": str(e)})
            cols = {n: batch.column(n) for n in given}
            for n in (*names, "error"):
                cols[n] = pa.array([x.get(n) for x in found], pa.map_(pa.string(), pa.string()) if n == "markers" else pa.string())
            yield pa.record_batch(cols)

    B.bound(rows.sparkSession)
    return rows.mapInArrow(run, f"{schema}, {made}, error string")


def protected(rows: DataFrame) -> DataFrame:
    """rows (id, source, ...) with protected and markers."""

    def f(row: dict) -> dict:
        text, markers = protect(row["source"], row["id"])
        return {"protected": text, "markers": list(markers.items())}

    return _mapped(rows, "protected string, markers map<string,string>", f)


def checked(rows: DataFrame) -> DataFrame:
    """rows (id, source, translated, ...) with result: page breaks restored and structure checked; else error."""

    def f(row: dict) -> dict:
        _, markers = protect(row["source"], row["id"])
        result = restore((row["translated"] or "").strip(), markers)
        check(row["source"], result)
        return {"result": result}

    return _mapped(rows, "result string", f)


def signatures(rows: DataFrame, column: str) -> DataFrame:
    """rows with signature, a text that is equal for equal structures."""
    return signed(rows, {"signature": column})


def signed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with a signature of each column, by the names that columns gives; one worker makes all of them."""
    return _mapped(rows, ", ".join(f"{name} string" for name in columns), lambda row: {name: structure(row[c]) for name, c in columns.items()})


def reassemble(docs: DataFrame, results: DataFrame, language: str | None = None) -> DataFrame:
    """book, path, content, error of documents with their results in place. results: book, xhtml_path, locator, result.

    A document without results stays as it is, and so does one with an error: malformed, or a result that
    doesn't fit its place.
    """
    each = results.groupBy("book", F.col("xhtml_path").alias("path")).agg(F.collect_list(F.struct("locator", "result")).alias("results"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches):
            contents, errors = [], []
            for row in batch.to_pylist():
                content, error = row["content"], None
                if row["results"] is not None:
                    try:
                        content = rewritten(content, [(tuple(r["locator"]), r["result"]) for r in row["results"]], language)
                    except (ValueError, LookupError) as e:
                        error = str(e)
                contents.append(content)
                errors.append(error)
            yield pa.record_batch({"book": batch.column("book"), "path": batch.column("path"), "content": pa.array(contents, pa.binary()), "error": pa.array(errors, pa.string())})

    B.bound(docs.sparkSession)
    return docs.select("book", "path", "content").join(each, ["book", "path"], "left").mapInArrow(run, "book string, path string, content binary, error string")


def rewritten(content: bytes, results: list[tuple[tuple[int, ...], str]], language: str | None) -> bytes:
    reading = Reading(content)
    blocks = {b.place: b for b in reading.blocks}
    for place, result in results:
        if place not in blocks:
            raise ValueError(f"no block at {'/'.join(map(str, place))}")
        check(blocks[place].structure, result)
    return reading.spliced([(blocks[place], result) for place, result in results], language)
