import base64
import glob
import gzip
import hashlib
import zlib

import pytest

from lodestar.llm import warc
from lodestar.llm.common import scratch


def _brute(rows):
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i is not None and i < newest[h or ""]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", newest[h or ""] if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c/é", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n\x1f\x8b \x00"), (5, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only"), (7, "l", "é" * 3_000_000)]


def test_write_normalise_read(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "page_id long, url string, html string, payload string, archive long").repartition(3)
    streams, archives = scratch(spark, "t-streams"), scratch(spark, "t-warc")
    warc.write(df, streams, records_per_archive=2)
    for f in glob.glob(f"{streams}/*.gz"):
        raw = open(f, "rb").read()
        whole = gzip.decompress(raw)
        assert whole.startswith(b"WARC/1.0\r\n") and whole.endswith(b"\r\n\r\n") and len(list(warc.records(raw))) <= 2
    warc.normalise(spark, streams, archives)
    got = warc.read(spark, archives).collect()
    assert len(got) == len(ROWS)
    by_id = {r.record_id: r for r in got}
    assert by_id[f"<{warc.URN}7>"].payload.decode() == "é" * 3_000_000
    assert by_id[f"<{warc.URN}4>"].payload.decode() == ROWS[3][2] and by_id[f"<{warc.URN}4>"].url == "http://c/é"
    assert by_id[f"<{warc.URN}1>"].payload is None and by_id[f"<{warc.URN}1>"].refers_to == f"<{warc.URN}9>"
    # every member can be reached alone, and the whole file inflates to the records in order
    for e in warc.index(spark, archives).collect():
        (f,) = glob.glob(f"{archives}/kind=0/archive={e.archive}/part-*")
        raw = open(f, "rb").read()
        assert warc.parse(gzip.decompress(raw[e.offset : e.offset + e.length]))["fields"]["warc-record-id"] == e.id
        assert [warc.parse(x)["fields"]["warc-record-id"] for x in warc.records(raw)][e.record] == e.id


def test_digest_rows_equal_brute_force(spark, sf_small, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(10_000 + i, "again", h) for i, (_, _, h) in enumerate(rows[:40])] + ROWS
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op7_warc(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_damaged_streams_keep_their_whole_records(spark, tmp_path):
    both = b"".join(warc.record(i, "u", b"p" * 500_000, None) for i in (1, 2))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(both)[:-400])
    (tmp_path / "text.gz").write_bytes(gzip.compress(b"no record\r\n\r\n"))
    (tmp_path / "many.gz").write_bytes(b"".join(gzip.compress(warc.record(i, "u", b"x", None)) for i in (3, 4)))
    (tmp_path / "none.gz").write_bytes(b"")
    target = scratch(spark, "t-damaged")
    warc.normalise(spark, str(tmp_path), target)
    kinds = sorted((r.file, r.id or "", r.type) for r in warc.index(spark, target).collect())
    assert [k for k in kinds if k[2] == "damaged"] == [("cut.gz", "", "damaged"), ("none.gz", "", "damaged"), ("text.gz", "", "damaged")]
    assert {r.record_id for r in warc.read(spark, target).collect()} >= {f"<{warc.URN}{i}>" for i in (1, 3, 4)}
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(both)[:-400]))


def _until_damage(raw):
    got = []
    with pytest.raises(ValueError):
        for r in warc.records(raw):
            got.append(r)
    return got


@pytest.mark.parametrize("cut", [1, 4, 8])
def test_streams_without_a_whole_trailer_are_damaged(cut):
    both = [warc.record(i, "u", b"p" * 1_000, None) for i in (1, 2)]
    assert _until_damage(gzip.compress(b"".join(both))[:-cut]) == both
    assert _until_damage(gzip.compress(both[0]) + gzip.compress(both[1])[:-cut]) == both


def test_streams_cut_at_a_records_end_are_damaged():
    one, two = (warc.record(i, "u", b"p" * 1_000, None) for i in (1, 2))
    z = zlib.compressobj(wbits=31)
    cut = z.compress(one) + z.flush(zlib.Z_FULL_FLUSH)
    assert _until_damage(cut) == [one]
    assert list(warc.records(cut + z.compress(two) + z.flush())) == [one, two]
    assert _until_damage(b"") == [] and list(warc.records(gzip.compress(b""))) == []


def test_a_common_payload_is_not_dealt_to_one_task(spark):
    """Payloads of one digest meet in no exchange: it deals by id and digest."""
    rows = [(i, "u", "same") for i in range(50)] + [(i, "u", None) for i in range(50, 60)] + [(None, "u", "same")] * 3
    target = scratch(spark, "t-common")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), target, min_revisit_bytes=1)
    made = [warc.parse(r)["fields"] for f in glob.glob(f"{target}/*.gz") for r in warc.records(open(f, "rb").read())]
    assert len(made) == 63 and sum(f["warc-type"] == "revisit" for f in made) == 49
    assert {f.get("warc-refers-to") for f in made} == {None, f"<{warc.URN}49>"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op7_warc(spark, str(tmp_path)).collect() == []
