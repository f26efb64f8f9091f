"""XML as events, against the standard library's trees."""

import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow import schemas as S
from quillflow.operators import fragments, inspect
from quillflow.operators.markup import BLOCKS, EPUB_NS, XHTML_NS, Malformed, Reading

DOCS = "book string, path string, content binary"
HEAD = f"<html xmlns='{XHTML_NS}' xmlns:epub=\"{EPUB_NS}\" lang='x'>"


def local(e):
    return e.tag.rpartition("}")[2]


def tree_blocks(root):
    """Places of the outermost blocks, by a walk."""
    found, todo = [], [((), root)]
    while todo:
        place, e = todo.pop()
        if local(e) in BLOCKS:
            found.append((place, e))
        else:
            todo += [((*place, k), c) for k, c in reversed(list(enumerate(e)))]
    return found


def shape(e):
    return e.tag, sorted(e.attrib.items()), [shape(c) for c in e]


NAMES = st.sampled_from(["p", "li", "div", "b", "epub:case", "h1", "q:p", "span"])
TEXT = st.text(alphabet="ab é<&>\"'\n\t😀]", max_size=6).map(lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
ATTRIBUTES = st.dictionaries(st.sampled_from(["id", "class", "epub:type", "xml:lang"]), st.sampled_from(["x", "a>b", "pagebreak", "it's"]), max_size=2).map(lambda d: "".join(f' {k}="{v}"' for k, v in d.items()))
EXTRA = st.sampled_from(["", "<!-- </p> -->", "<?go </p> ?>", "<![CDATA[<p>]]>"])


def elements(children):
    def made(name, attributes, inner, after):
        own = " xmlns:q='http://q.test/'" if name.startswith("q:") else ""
        return f"<{name}{own}{attributes}>{''.join(inner)}</{name} >{after}" if inner else f"<{name}{own}{attributes}/>{after}"

    return st.builds(made, NAMES, ATTRIBUTES, st.lists(children, max_size=4), st.one_of(TEXT, EXTRA))


BODY = st.recursive(st.one_of(TEXT, EXTRA), elements, max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(elements(BODY), max_size=3))
def test_blocks_and_structures_as_in_trees(parts):
    text = f"<?xml version='1.0' encoding='utf-8'?>\n{HEAD}{''.join(parts)}</html>\n<!-- end -->"
    raw, root = text.encode(), ET.fromstring(text.encode())
    reading = Reading(raw)
    expected = tree_blocks(root)
    assert [b.place for b in reading.blocks] == [p for p, _ in expected]
    assert [b.blank for b in reading.blocks] == [not "".join(e.itertext()).strip() for _, e in expected]
    pieces = [reading.piece(b) for b in reading.blocks]
    for piece, block, (_, e) in zip(pieces, reading.blocks, expected):
        own = ET.fromstring(piece)
        assert shape(own) == shape(e) and "".join(own.itertext()) == "".join(e.itertext())
        assert Reading(piece).structure == block.structure
    for i, (_, a) in enumerate(expected):
        for j, (_, b) in enumerate(expected):
            assert (reading.blocks[i].structure == reading.blocks[j].structure) == (shape(a) == shape(b))
    # what comes back unchanged leaves every byte as it was, and one change leaves all others
    assert reading.spliced(list(zip(reading.blocks, pieces))) == raw
    if expected:
        first, place = reading.blocks[0], expected[0][0]
        done = fragments.rewritten(raw, [(place, pieces[0])], "fr")
        assert ET.fromstring(done).get("lang") == ET.fromstring(done).get("{http://www.w3.org/XML/1998/namespace}lang") == "fr"
        assert done.endswith(raw[first.stop :]) and shape(ET.fromstring(done))[2] == shape(root)[2]


def test_any_depth():
    deep = "<div>" * 30_000 + "<p>" + "<b>" * 30_000 + "x" + "</b>" * 30_000 + "</p>" + "</div>" * 30_000
    reading = Reading(f"{HEAD}{deep}</html>".encode())
    (block,) = reading.blocks
    assert len(block.place) == 30_001 and Reading(reading.piece(block)).structure == block.structure
    assert fragments.structure("<a>" * 5000 + "</a>" * 5000) != fragments.structure("<a>" * 5001 + "</a>" * 5001)
    text, markers = fragments.protect(reading.piece(block), 1)
    fragments.check(reading.piece(block), fragments.restore(text, markers))


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1", "utf-16", "windows-1252"])
def test_encodings_are_kept(encoding):
    text = f"<?xml version='1.0' encoding='{encoding}'?>{HEAD}<p>é&#x20AC;</p>né</html>"
    raw = text.encode(encoding)
    done = fragments.rewritten(raw, [((0,), "<p>ü€😀</p>".replace("<p>", f"<p xmlns='{XHTML_NS}'>"))], None)
    root = ET.fromstring(done)
    assert root[0].text == "ü€😀" and root[0].tail == "né" and done.decode(encoding).startswith(text[:60])


def test_entities_of_the_document_and_of_none():
    raw = b"<!DOCTYPE html [<!ENTITY co 'A &amp; <b>B</b>'><!ENTITY two '&co;&co;'>]><html><p>&two;<![CDATA[&co;]]></p></html>"
    piece = Reading(raw).piece(Reading(raw).blocks[0])
    assert "".join(ET.fromstring(piece).itertext()) == "A & BA & B&co;"
    for bad in ("<p>&nbsp;</p>", "<p>", "", "<p/><p/>", "<e:p/>", "<p a='1' a='2'/>"):
        with pytest.raises(Malformed):
            Reading(bad)


def test_root_that_is_a_block():
    assert fragments.rewritten(b"<p class='a' xml:lang='de' lang=\"de\">x</p><!-- y -->", [((), "<p class='a' xml:lang='de' lang='de'>z</p>")], "a&b") == b'<p class=\'a\' lang="a&amp;b" xml:lang="a&amp;b">z</p><!-- y -->'
    assert fragments.rewritten(b"<html/>", [], "fr") == b'<html lang="fr" xml:lang="fr"/>'
    with pytest.raises(ValueError, match="no block at 0/1"):
        fragments.rewritten(b"<html><p/></html>", [((0, 1), "<p/>")], None)


def test_page_breaks_number_by_parent():
    source = f"<p xmlns='{XHTML_NS}' xmlns:e='{EPUB_NS}'><b>x<span e:type='pagebreak'>  </span></b>y<span e:type='pagebreak' id='o'/><span e:type='pagebreak'>no</span><span e:type='pagebreak'><i/></span></p>"
    text, markers = fragments.protect(source, 3)
    assert "x[[KEEP_PAGEBREAK_3_1]]</b>y[[KEEP_PAGEBREAK_3_0]]<span" in text and len(markers) == 2
    assert "id='o'" in markers["[[KEEP_PAGEBREAK_3_0]]"] and shape(ET.fromstring(fragments.restore(text, markers))) == shape(ET.fromstring(source))


# ---- quarantine


def test_malformed_documents_stand_beside_sound_ones(spark):
    rows = [("b", "good", f"{HEAD}<p>one</p><p> </p></html>".encode()), ("b", "entity", b"<html><p>a&nbsp;b</p></html>"), ("c", "open", b"<html>"), ("c", "none", None), ("c", "deep", ("<i>" * 4000 + "<p>x</p>" + "</i>" * 4000).encode())]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    assert sorted((r["xhtml_path"], len(r["locator"])) for r in fragments.extract(docs).collect()) == [("deep", 4000), ("good", 1)]
    assert sorted((r["xhtml_path"], r["error"].partition(":")[0]) for r in fragments.malformed(docs).collect()) == [("entity", "undefined entity"), ("none", "no element found"), ("open", "no element found")]
    results = spark.createDataFrame([("b", "good", [0], f"<p xmlns='{XHTML_NS}'>un</p>"), ("b", "entity", [0], "<p/>"), ("c", "deep", [0], "<p/>")], "book string, xhtml_path string, locator array<int>, result string")
    got = {r["path"]: (r["content"], r["error"]) for r in fragments.reassemble(docs, results).collect()}
    assert bytes(got["good"][0]) == rows[0][2].replace(b"one", b"un") and got["good"][1] is None and got["open"] == (b"<html>", None)
    assert got["deep"][1] == "no block at 0" and bytes(got["entity"][0]) == rows[1][2] and "undefined" in got["entity"][1]


def test_inspection_names_what_is_wrong(spark):
    opf = lambda *hrefs: f"<package><manifest>{''.join(f'<item id=\"{k}\" href=\"{h}\" media-type=\"application/xhtml+xml\"/>' for k, h in enumerate(hrefs))}</manifest><spine/></package>".encode()
    rows = [("ok", "x.opf", opf("a", "b")), ("ok", "a", b"<html><title>T</title></html>"), ("ok", "b", b"<html>&nbsp;</html>")]
    rows += [("gone", "x.opf", opf("a", "../../a", "b")), ("gone", "b", b"<html/>"), ("bare", "a", b""), ("torn", "x.opf", b"<package>")]
    rows += [("odd", "META-INF/container.xml", b"<container>"), ("odd", "OEBPS/content.opf", opf("c")), ("odd", "OEBPS/c", b"<html><h1>C</h1></html>")]
    members = spark.createDataFrame([(b, m, 0, False, c) for b, m, c in rows], S.MEMBERS)
    got = sorted((r["book"], r["path"] or "", r["title"] or "", (r["error"] or "").partition(":")[0]) for r in inspect.inspect_all(members).collect())
    assert got == [
        ("bare", "", "", "could not find EPUB package document of bare"),
        ("gone", "", "", "manifest item escapes EPUB root"), ("gone", "a", "", "manifest item is not there"), ("gone", "b", "", ""),
        ("odd", "OEBPS/c", "C", ""), ("ok", "a", "T", ""), ("ok", "b", "", "undefined entity"), ("torn", "x.opf", "", "no element found"),
    ]
    for book, message in (("bare", "could not find"), ("gone", "manifest item"), ("torn", "no element found"), ("ok", "undefined entity")):
        with pytest.raises(Exception, match=message):
            inspect.inspect(members.where(members.book == book)).select("path").collect()
