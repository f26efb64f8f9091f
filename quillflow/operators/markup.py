"""XML read as events: where its text blocks lie, and what structure it has, without a tree.

One pass of the parser gives the byte ranges of the outermost blocks and a digest of each one's tags,
attributes and nesting, built as elements close. Nothing is recursive, so any depth will do; text that is
not touched is never written anew.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass, field
from xml.parsers import expat

# Elements that are translated as one piece.
BLOCKS = frozenset({"p", "li", "td", "th", "caption", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"})
# Namespaces.
XHTML_NS, EPUB_NS, XML_NS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.w3.org/XML/1998/namespace"
#: Between the parts of an expanded name; no XML text holds it.
_SEP = "\x1f"
_PAGE_BREAK = ("span", f"{EPUB_NS}{_SEP}type", "pagebreak")
_TAG = re.compile(rb"<([^\s/>]+)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>")
_ATTRIBUTE = re.compile(rb"\s+([^\s=/>]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITY = re.compile(r"<!\[CDATA\[.*?\]\]>|&([^#;&\s][^;&\s]*);", re.S)
_PLAIN_ENTITIES = frozenset({"amp", "lt", "gt", "quot", "apos"})


class Malformed(ValueError):
    """No well-formed XML; the message is the parser's."""


@dataclass
class Span:
    """An element's bytes; for a block, where it stands and what it needs around it."""

    start: int
    stop: int = 0
    place: tuple[int, ...] = ()
    scope: dict[str, str] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)
    blank: bool = True
    structure: bytes = b""


class _NoDigest:
    """Of nothing."""

    def update(self, data: bytes) -> None:
        pass

    def digest(self) -> bytes:
        return b""


_NO_DIGEST = _NoDigest()


class Reading:
    """One pass over a document. blocks: its outermost blocks in order; breaks: its empty page breaks, by parent and place.

    Without structures no digests are made, which take much of the time.
    """

    def __init__(self, content: bytes | str, structures: bool = True):
        self._structures = structures
        self.utf16 = isinstance(content, bytes) and content[:2] in (b"\xff\xfe", b"\xfe\xff")
        if self.utf16:
            content = content.decode("utf-16")
        fixed = "utf-8" if isinstance(content, str) else None
        self.data = content.encode() if isinstance(content, str) else bytes(content)
        self.encoding = "utf-8"
        self.entities: dict[str, str] = {}
        self.blocks: list[Span] = []
        self.root: Span | None = None
        self._open: list[tuple[object, list[int]]] = []  # of each open element: its digest so far, and its child's number
        self._scopes: list[dict[str, str]] = [{}]
        self._declared = 0  # by the tag that comes
        self._block: Span | None = None
        self._depth = 0
        self._found: list[tuple[int, Span]] = []
        self._candidate: Span | None = None
        self._order: list[int] = []
        self._seen = 0
        self._parser = p = expat.ParserCreate(fixed, _SEP)
        p.namespace_prefixes = p.ordered_attributes = p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.StartNamespaceDeclHandler, p.EndNamespaceDeclHandler = self._declare, self._undeclare
        p.EntityDeclHandler = self._entity
        if fixed is None:
            p.XmlDeclHandler = self._declaration
        try:
            p.Parse(self.data, True)
        except expat.ExpatError as e:
            raise Malformed(str(e)) from None
        self.breaks = [span for _, span in sorted(self._found, key=lambda x: (x[0], x[1].start))]

    # ---- events

    def _declaration(self, version: str, encoding: str | None, standalone: int) -> None:
        self.encoding = encoding or "utf-8"

    def _entity(self, name: str, is_parameter: int, value: str | None, *rest: object) -> None:
        if not is_parameter and value is not None:
            self.entities.setdefault(name, value)

    def _declare(self, prefix: str | None, uri: str | None) -> None:
        self._scopes.append({**self._scopes[-1], prefix or "": uri or ""})
        self._declared += 1

    def _undeclare(self, prefix: str | None) -> None:
        self._scopes.pop()

    @staticmethod
    @functools.lru_cache(1024)
    def _name(expanded: str) -> tuple[str, str, str | None]:
        """The name without its prefix, its local part, and the prefix, None where it has no namespace."""
        parts = expanded.split(_SEP)
        return _SEP.join(parts[:2]), parts[min(1, len(parts) - 1)], None if len(parts) == 1 else parts[2] if len(parts) == 3 else ""

    def _start(self, tag: str, attributes: list[str]) -> None:
        at, (name, local, prefix) = self._parser.CurrentByteIndex, self._name(tag)
        around, self._declared = self._scopes[-1 - self._declared], 0
        pairs = [(self._name(k), v) for k, v in zip(attributes[::2], attributes[1::2])] if attributes else []
        digest = hashlib.sha256(repr((name, sorted((k[0], v) for k, v in pairs))).encode("utf-8", "surrogatepass")) if self._structures else _NO_DIGEST
        if self._open:
            self._open[-1][1][0] += 1
        else:
            self.root = Span(at, scope=around)
        self._order.append(self._seen)
        self._seen += 1
        self._candidate = None
        if self._block is None and local in BLOCKS:
            self._block, self._depth = Span(at, place=tuple(x[1][0] for x in self._open), scope=around), len(self._open)
        if self._block is not None:
            self._block.used.update([p for p in (prefix, *(k[2] for k, _ in pairs)) if p is not None])
        if self._open and local == _PAGE_BREAK[0] and (_PAGE_BREAK[1], _PAGE_BREAK[2]) in {(k[0], v) for k, v in pairs}:
            self._candidate = Span(at, scope=around, used={p for p in (prefix, *(k[2] for k, _ in pairs)) if p is not None})
        self._open.append((digest, [-1]))

    def _end(self, tag: str) -> None:
        digest, _ = self._open.pop()
        self._order.pop()
        structure = digest.digest()
        if self._open:
            self._open[-1][0].update(structure)
        else:
            self.structure = structure
            self.root.stop = self._stop(self.root)
        if self._candidate is not None:
            self._candidate.stop = self._stop(self._candidate)
            self._found.append((self._order[-1], self._candidate))
            self._candidate = None
        if self._block is not None and len(self._open) == self._depth:
            self._block.stop, self._block.structure = self._stop(self._block), structure
            self.blocks.append(self._block)
            self._block = None

    def _stop(self, span: Span) -> int:
        """Where an element that ends here ends."""
        tag = _TAG.match(self.data, span.start)
        return tag.end() if tag[0].endswith(b"/>") else self.data.index(b">", self._parser.CurrentByteIndex) + 1

    def _text(self, text: str) -> None:
        if text.strip():
            self._candidate = None
            if self._block is not None:
                self._block.blank = False

    # ---- pieces

    def piece(self, span: Span) -> str:
        """An element by itself: with the namespaces it takes from around it, and without the document's own entities."""
        raw = self.data[span.start : span.stop]
        tag = _TAG.match(raw)
        own = {k.partition(b":")[2].decode() for k in _names(tag[2]) if k == b"xmlns" or k.startswith(b"xmlns:")} if b"xmlns" in tag[2] else ()
        text = raw[tag.end(1) :].decode(self.encoding)
        outer = "".join(f' xmlns{":" if p else ""}{p}="{_quoted(uri)}"' for p, uri in sorted(span.scope.items()) if uri and p in span.used and p not in own)
        whole = raw[: tag.end(1)].decode(self.encoding) + outer + text
        return self._expanded(whole, 0) if self.entities else whole

    def _expanded(self, text: str, depth: int) -> str:
        if depth > 8:
            raise Malformed("entities nest too deep")
        known = lambda m: m[0] if m[1] is None or m[1] in _PLAIN_ENTITIES or m[1] not in self.entities else self._expanded(self.entities[m[1]], depth + 1)
        return _ENTITY.sub(known, text)

    def spliced(self, pieces: list[tuple[Span, str]], language: str | None = None) -> bytes:
        """The document with elements in place of others, and its root's language; all other bytes as they were."""
        edits = [(span.start, span.stop, self._fitted(text, span.scope)) for span, text in pieces]
        if language:
            whole = next((k for k, (a, _, _) in enumerate(edits) if a == self.root.start), None)
            if whole is not None:
                edits[whole] = (*edits[whole][:2], _with_language(edits[whole][2], language))
            else:
                tag = _TAG.match(self.data, self.root.start)
                edits.append((tag.start(), tag.end(), _with_language(tag[0], language)))
        out, at = [], 0
        for start, stop, new in sorted(edits):
            out += [self.data[at:start], new]
            at = stop
        done = b"".join([*out, self.data[at:]])
        return done.decode().encode("utf-16") if self.utf16 else done

    def _fitted(self, text: str, scope: dict[str, str]) -> bytes:
        """An element as it stands in the document: in its encoding, without declarations that hold there anyway."""
        raw = text.strip().encode(self.encoding, "xmlcharrefreplace")
        tag = _TAG.search(raw, _root_at(raw))
        known = {b"xmlns" + (b":" + p.encode() if p else b""): _quoted(uri).encode() for p, uri in scope.items()}
        rest = _ATTRIBUTE.sub(lambda m: b"" if known.get(m[1]) == m[2][1:-1] else m[0], tag[2])
        return b"<" + tag[1] + rest + b">" + raw[tag.end() :]


def _names(attributes: bytes) -> list[bytes]:
    return [m[1] for m in _ATTRIBUTE.finditer(attributes)]


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _root_at(raw: bytes) -> int:
    """Where the first element begins, after declarations, comments and instructions."""
    at = 0
    while m := re.compile(rb"\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)", re.S).match(raw, at):
        at = m.end()
    return at


def _with_language(markup: bytes, language: str) -> bytes:
    """markup whose first tag has lang and xml:lang; others of these names go."""
    tag = _TAG.search(markup, _root_at(markup))
    value = _quoted(language).encode("ascii", "xmlcharrefreplace")
    rest = _ATTRIBUTE.sub(lambda m: b"" if m[1] in (b"lang", b"xml:lang") else m[0], tag[2])
    end = b"/" if rest.rstrip().endswith(b"/") else b""
    rest = rest.rstrip()[: -1 or None].rstrip() if end else rest.rstrip()
    new = b"<" + tag[1] + rest + b' lang="' + value + b'" xml:lang="' + value + b'"' + end + b">"
    return markup[: tag.start()] + new + markup[tag.end() :]
