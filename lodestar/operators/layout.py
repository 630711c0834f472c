"""Workbook documents of any layout -> one flat layout (IO-04).

Workbook writers nest the same things differently: relations sit in a versioned
wrapper element, joins nest their operands, column metadata sits under the
connection or beside it, dashboard zones and group filters nest to any depth,
button captions are attributes or child elements.  ``flatten`` rewrites a
document so that ``extract.parse`` can read it against one fixed schema:

* every relation is a direct child of the datasource's connection; a join
  keeps its own clause and kind, its operands follow it; a clause is one
  expression with all others as direct children, in document order, each with
  its number (``n``) and that of the expression it stood in (``parent``);
* metadata records are a direct child of the datasource;
* zones are direct children of ``zones``, in document order;
* a group filter has its descendants as direct children, level by level;
* a datasource without caption is called by its name;
* elements that no extractor reads (images, styles, windows, ...) are left out.

A datasource with relations outside of the places that are read is marked
(``unread-relations``), and ``extract.errors`` reports its document.  The
rewriting is a map over the documents (Arrow batches, no shuffle); malformed
documents pass through unchanged and become error rows at the parse.

Documents are read by events: what no extractor reads is never kept, a
datasource, worksheet or dashboard is written as soon as it ends, and metadata
records as soon as each of them ends.  So a worker holds the document's bytes,
those of its rewritten form, and the tree of one datasource without its records.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.session import ship_library

# Wrapper elements of relations, the preferred one first, and elements that
# repeat relations for other purposes (their names' end) (fixed values).
REPEATS = "object-graph"
WRAPPERS = ("_.fcp.ObjectModelEncapsulateLegacy.false...relation", "_.fcp.ObjectModelEncapsulateLegacy.true...relation")

#: Sections of a workbook and the elements that are read in them.
SECTIONS = {"datasources": "datasource", "worksheets": "worksheet", "dashboards": "dashboard"}
#: Elements whose whole content is a value, and others whose leading text is read.
_VALUES = frozenset("remote-name local-name parent-name local-type min max rows cols run".split())
_WORDED = frozenset(("relation", "caption", *WRAPPERS))
#: All elements that an extractor reads; others stay only around these.
_READ = _VALUES | _WORDED | frozenset(
    "datasource connection named-connections named-connection clause expression extract metadata-records metadata-record column calculation "
    "filter groupfilter worksheet table view datasources panes pane mark encodings color size text tooltip lod shape path angle geometry "
    "dashboard zones zone formatted-text button".split()
)
#: Bytes that the parser takes at a time, and of small documents in an Arrow batch.
_CHUNK, _BATCH = 1 << 20, 4 << 20
_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"})
_ATTRIBUTE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


class _Written(ET.Element):
    """Stands for elements that are written already (``body``)."""


def _start(tag: str, attributes: dict) -> bytes:
    return ("<" + tag + "".join(f' {k}="{v.translate(_ATTRIBUTE)}"' for k, v in attributes.items()) + ">").encode()


def _write(e: ET.Element, out: io.BytesIO) -> None:
    if isinstance(e, _Written):
        out.write(e.body.getbuffer())
        return
    out.write(_start(e.tag, e.attrib))
    if e.text:
        out.write(e.text.translate(_TEXT).encode())
    for child in e:
        _write(child, out)
        if child.tail:
            out.write(child.tail.translate(_TEXT).encode())
    out.write(f"</{e.tag}>".encode())


class _Reader:
    """Events of one document -> its flat layout in ``out``.

    Names keep their prefixes, which documents may leave undeclared.
    """

    def __init__(self) -> None:
        self.out = io.BytesIO()
        self.parser = expat.ParserCreate("utf-8")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.depth = self.skipped = self.valued = 0
        self.open: list[ET.Element] = []  # from the section's child inwards
        self.begun: list[bool] = []  # whether a child has begun in it
        self.pending: list[str] = []

    def start(self, tag: str, attributes: dict) -> None:
        self.depth += 1
        if self.skipped or (self.depth == 2 and tag not in SECTIONS):
            self.skipped += 1
        elif self.depth <= 2:
            self.out.write(_start(tag, attributes))
        else:
            self.flush()
            if self.begun:
                self.begun[-1] = True
            self.valued += bool(self.valued or tag in _VALUES)
            self.open.append(ET.Element(tag, attributes))
            self.begun.append(False)

    def text(self, data: str) -> None:
        if self.open and not self.skipped and (self.valued or (self.open[-1].tag in _WORDED and not self.begun[-1])):
            self.pending.append(data)

    def flush(self) -> None:
        """Pending text goes behind the last child, or to the element's beginning."""
        if self.pending:
            e, data = self.open[-1], "".join(self.pending)
            if len(e):
                e[-1].tail = (e[-1].tail or "") + data
            else:
                e.text = (e.text or "") + data
            self.pending.clear()

    def end(self, tag: str) -> None:
        self.depth -= 1
        if self.skipped:
            self.skipped -= 1
        elif self.depth < 2:
            self.out.write(f"</{tag}>".encode())
        else:
            self.flush()
            e, kept = self.open.pop(), self.valued or tag in _READ or tag.endswith(REPEATS)
            self.begun.pop()
            self.valued -= bool(self.valued)
            if not kept and not len(e):
                return
            if not self.open:
                _section(e)
                _write(e, self.out)
            elif tag == "metadata-record" and not self.valued and self.open[-1].tag == "metadata-records":
                home = self.open[-1]
                if not len(home) or not isinstance(home[-1], _Written):
                    made = _Written(tag)
                    made.body = io.BytesIO()
                    home.append(made)
                _write(e, home[-1].body)
            else:
                self.open[-1].append(e)


def _section(e: ET.Element) -> None:
    if e.tag == "datasource":
        _datasource(e)
    elif e.tag == "worksheet":
        for f in e.iter("filter"):
            _filter(f)
    elif e.tag == "dashboard":
        _dashboard(e)


def _take(parent: ET.Element, found: list[ET.Element]) -> None:
    """Removes elements from wherever they are below ``parent``, in one walk."""
    gone = {id(e) for e in found}
    for p in parent.iter():
        if any(id(e) in gone for e in p):
            p[:] = [e for e in p if id(e) not in gone]


def _relations(ds: ET.Element) -> None:
    connection = ds.find("connection")
    repeated = {id(e) for g in ds.iter() if g.tag.endswith(REPEATS) for e in g.iter()}
    every = [e for e in ds.iter() if (e.tag == "relation" or e.tag in WRAPPERS) and id(e) not in repeated]
    if not every:
        return
    top = next((w for name in WRAPPERS if (w := ds.find(f".//{name}")) is not None and id(w) not in repeated), None)
    if top is not None:
        nested = [r for r in top.iter("relation") if id(r) not in repeated]
        # a wrapper without nested relations is the relation; a joined wrapper is a join beside them
        roots = [top] if not nested or top.get("join") else []
        read = [*roots, *nested]
        known = {id(e) for w in every if w.tag in WRAPPERS for e in w.iter()} | {id(w) for w in every if w.tag in WRAPPERS}
    else:
        direct = connection.findall("relation") if connection is not None else []
        read = [r for d in direct for r in d.iter("relation")]
        known = {id(e) for e in read}
    lost = sum(id(e) not in known for e in every)
    if connection is None:
        connection = ET.SubElement(ds, "connection")
    flat = []
    for r in read:
        made = ET.Element("relation", dict(r.attrib))
        made.text = r.text
        made.extend(_clause(c) for c in r.findall("clause"))
        flat.append(made)
    _take(ds, every)
    connection.extend(flat)
    if lost:
        ds.set("unread-relations", str(lost))


def _clause(clause: ET.Element) -> ET.Element:
    made, flat = ET.Element("clause", dict(clause.attrib)), []

    def walk(parent: ET.Element, number: int) -> None:
        for e in parent.findall("expression"):
            own = {"n": str(len(flat))} | ({"parent": str(number)} if number >= 0 else {})
            flat.append(ET.Element("expression", dict(e.attrib) | own))
            walk(e, len(flat) - 1)

    walk(clause, -1)
    made.extend(flat[:1])
    for outer in made:
        outer.extend(flat[1:])
    return made


def _datasource(ds: ET.Element) -> None:
    if ds.get("caption") is None and ds.get("name") is not None:
        ds.set("caption", ds.get("name"))
    _relations(ds)
    connection = ds.find("connection")
    for name, home in (("metadata-records", ds), ("named-connections", connection), ("extract", ds)):
        found = ds.find(f".//{name}")
        if found is not None and home is not None and found not in list(home):
            _take(ds, [found])
            home.append(found)
    for f in ds.findall("filter"):
        _filter(f)


def _filter(f: ET.Element) -> None:
    queue, order = list(f.findall("groupfilter")), []
    for g in queue:  # grows while it is read
        order.append(g)
        queue += g.findall("groupfilter")
    if len(order) > 1:
        for g in order:
            g[:] = []
        f[:] = [e for e in f if e.tag != "groupfilter"]
        f.append(order[0])
        order[0].extend(order[1:])


def _dashboard(db: ET.Element) -> None:
    zones = db.find("zones")
    if zones is None:
        return
    every = list(zones.iter("zone"))
    for z in every:
        z[:] = [e for e in z if e.tag != "zone"]
        for b in z.findall("button"):
            caption = b.find("caption")
            if b.get("caption") is None and caption is not None:
                b.set("caption", caption.text or "")
    zones[:] = [e for e in zones if e.tag != "zone"]
    zones.extend(every)


def rewrite(document) -> io.BytesIO | None:
    """The flat layout of a document's UTF-8 bytes (any buffer); None if it cannot be parsed."""
    reader, view = _Reader(), memoryview(document)
    try:
        for at in range(0, len(view), _CHUNK):
            reader.parser.Parse(view[at : at + _CHUNK], False)
        reader.parser.Parse(b"", True)
    except (expat.ExpatError, ValueError):
        return None
    return reader.out


def flatten(text: str | None) -> str | None:
    """The document in the flat layout; as it is if it cannot be parsed."""
    if text is None:
        return None
    made = rewrite(text.encode())
    return text if made is None else made.getvalue().decode()


def flatten_documents(docs: DataFrame) -> DataFrame:
    """(path, content) with every content in the flat layout."""
    ship_library(docs.sparkSession)

    def rows(paths: list, contents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())], ["path", "content"])

    def run(batches):
        for b in batches:
            paths, contents, held = [], [], 0
            for i, path in enumerate(b.column(0).to_pylist()):
                given = b.column(1)[i].as_buffer()  # no copy of the document
                made = None if given is None else rewrite(given)
                size = len(made.getbuffer()) if made else given.size if given is not None else 0
                if made and size > _BATCH:  # goes out as it lies in memory
                    ends = pa.array([0, size], pa.int32()).buffers()[1]
                    one = pa.StringArray.from_buffers(1, ends, pa.py_buffer(made.getbuffer()))
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), one], ["path", "content"])
                    continue
                paths.append(path)
                contents.append(made.getvalue() if made else None if given is None else given.to_pybytes())
                held += size
                if held > _BATCH:
                    yield rows(paths, contents)
                    paths, contents, held = [], [], 0
            if paths:
                yield rows(paths, contents)

    return docs.select("path", "content").mapInArrow(run, "path string, content string")
