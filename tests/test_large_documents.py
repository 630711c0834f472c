"""Documents are read by events: what nobody reads is not kept, and memory is bounded by the document's bytes."""

import resource
import subprocess
import sys
from pathlib import Path

from lodestar.operators import extract as X
from lodestar.operators.layout import flatten

ROOT = Path(__file__).resolve().parent.parent

RECORD = "<metadata-record class='column'><remote-name>r{0}</remote-name><remote-type>20</remote-type><local-name>[l{0}]</local-name><parent-name>[a]</parent-name><ordinal>{0}</ordinal><local-type>string</local-type><aggregation>Count</aggregation><attributes><attribute datatype='string'>x</attribute></attributes></metadata-record>"
HEAD = "<workbook><preferences><p v='1'/></preferences><datasources><datasource name='n' caption='c'><connection class='federated'><relation name='a' table='[S].[a]' type='table'/><metadata-records>"
TAIL = "</metadata-records></connection><style><rule><zone/></rule></style></datasource></datasources><thumbnails><thumbnail>{0}</thumbnail></thumbnails></workbook>"


def _document(records, image):
    return HEAD + "".join(RECORD.format(i) for i in range(records)) + TAIL.format("A" * image)


def test_elements_that_nobody_reads_are_left_out():
    made = flatten(_document(2, 50_000))
    assert len(made) < 1_000 and "AAAA" not in made and "thumbnail" not in made and "ordinal" not in made
    assert made.count("<metadata-record ") == 2 and "<remote-name>r1</remote-name>" in made


def test_texts_and_attributes_come_back_as_they_were(spark):
    formula = "IF [a] &lt; 1 &amp;&amp; [b] = &quot;x&quot;&#10;THEN 'é' // t&#9;END"
    sql = "SELECT 1 &lt; 2<![CDATA[ & <b> ]]>"
    ds = f"<datasource name='n'><connection><relation name='q' type='text'>{sql}<columns><column name='no'/></columns> after</relation></connection><column name='[k]'><calculation class='x' formula=\"{formula}\"/></column></datasource>"
    runs = "<dashboards><dashboard name='d'><zones><zone id='1'><formatted-text><run>one &amp; two</run><run>  </run></formatted-text></zone></zones></dashboard></dashboards>"
    wb = X.parse(spark.createDataFrame([("w", f"<workbook><datasources>{ds}</datasources>{runs}</workbook>")], "path string, content string")).first().wb
    d = wb.datasources.datasource[0]
    assert d.column[0].calculation._formula == "IF [a] < 1 && [b] = \"x\"\nTHEN 'é' // t\tEND"
    assert d.connection.relation[0]._VALUE == "SELECT 1 < 2 & <b>"
    assert wb.dashboards.dashboard[0].zones.zone[0]["formatted-text"].run[0] == "one & two"


def test_large_and_small_documents_in_one_batch(spark):
    docs = [("small", _document(1, 0)), ("large", _document(30_000, 1_000_000)), ("bad", "<workbook><a>"), ("null", None), ("empty", ""), ("last", _document(3, 0))]
    parsed = X.parse(spark.createDataFrame(docs, "path string, content string").coalesce(1))
    found = {r.path: r["count"] for r in X.columns(parsed).groupBy("path").count().collect()}
    assert found == {"small": 1, "large": 30_000, "last": 3}
    assert {r.path for r in X.errors(parsed).collect()} == {"bad", "null", "empty"}


def test_memory_is_bounded_by_the_bytes_of_the_document(tmp_path):
    """A document of 64 MB, half of it records and half an image, in a process of its own."""
    script = tmp_path / "large.py"
    script.write_text(
        "import resource, sys\n"
        f"sys.path[:0] = [{str(ROOT)!r}, {str(ROOT / 'tests')!r}]\n"
        "from test_large_documents import HEAD, RECORD, TAIL\n"
        "from lodestar.operators.layout import rewrite\n"
        "doc, i = bytearray(HEAD.encode()), 0\n"
        "while len(doc) < 32 << 20:\n"
        "    doc += RECORD.format(i).encode(); i += 1\n"
        "doc += TAIL.format('A' * (32 << 20)).encode()\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "made = rewrite(doc).getbuffer()\n"
        "print(i, bytes(made).count(b'<metadata-record '), len(made), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)\n"
    )
    done = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=120, check=True)
    records, kept, size, grown = map(int, done.stdout.split()[-4:])
    assert kept == records
    assert grown * 1024 < 3 * size + (32 << 20)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss > 0
