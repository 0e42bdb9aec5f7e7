"""Archives are read back by their index alone and hold what was written."""

import gzip
import hashlib
import os

import pytest

from leadquarry.llm import warc

SCHEMA = "page_id long, url string, html string, key string, payload string, part string, n long, file string, refers_to string"
HOSTILE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3


def pages():
    same = "copy " * 40
    out = [(i, f"https://www.Host{i % 3}.example.com/p?id={i}", f"<html>é {i} " + "x" * (i % 300)) for i in range(400)]
    out += [(1000 + i, "http://hot.example.org/", same) for i in range(700)]  # one URL, one payload
    out += [(2000, None, None), (2001, "", ""), (2002, "no scheme", "short"), (2003, "no scheme", "short"), (None, "http://hot.example.org/", same),
            (2004, "http://a.b/\n\"q\" ", HOSTILE), (2005, "http://a.b/", HOSTILE), (2006, "http://u:p@A.b:81", "汉" * 33), (2007, "http://A.b:81/", "汉" * 34),
            (2008, "http://a.b:81/", "汉" * 34), (2009, "http://long.example/", "y" * 3_000_000), (2010, "x", "rep" * 50), (2010, "x", "rep" * 50),
            (2011, "x", "rep" * 50), (None, "only", "unnamed" * 20), (None, "only", "unnamed" * 20)]
    return out


@pytest.fixture(scope="module")
def written(spark):
    frame = spark.createDataFrame([(*r, *["1"] * 3, 1, *["1"] * 2) for r in pages()], SCHEMA).repartition(4)
    archive = warc.write(frame, parts=3)
    yield frame, archive
    archive.remove()
    assert not os.path.exists(archive.folder)


def test_read_back(spark, written):
    frame, archive = written
    first = {}
    for i, _, h in pages():
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in pages():
        raw = (h or "").encode()
        again = first.get(h) is not None and first[h] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    captures = warc.lookup(archive, frame, page_id="page_id")
    got = [tuple(r) for r in warc.resolved(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = {(r.page_id, r.url): r for r in captures.collect()}
    for i, u, h in pages():
        r = texts[i, u]
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload).decode() == (h or ""))


def test_index_searches(spark, written):
    _, archive = written
    ask = lambda *urls: warc.lookup(archive, spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert len(ask("http://hot.example.org/", "http://HOT.example.org")) == 701  # over several blocks, asked once
    assert {r.page_id for r in ask("http://a.b:81/")} == {2006, 2007, 2008}
    assert ask("http://hot.example.org/none", "zzz", "!") == [] and {r.page_id for r in ask(None)} == {2000, 2001}
    parts = archive.parts()
    assert len(parts) == 3 and all(warc._order(a.last) < warc._order(b.first) for a, b in zip(parts, parts[1:]))
    reader = warc._Reader(archive.folder, parts)
    assert any(len(reader.directory(p)[1]) > 1 for p in parts)


def test_archives_are_plain_warc(spark, written):
    _, archive = written
    for row in warc.lookup(archive, spark.createDataFrame([("http://a.b/",)], "url string")).collect():
        with open(f"{archive.folder.removeprefix('file://')}/{row.file}", "rb") as f:
            f.seek(row.offset)
            raw = f.read(row.length)
        fields, payload = warc.parse(gzip.decompress(raw))
        assert fields["WARC-Type"] == row.record_type and (row.record_type == "revisit" or payload.decode() == HOSTILE)
    whole = b"".join(gzip.open(f"{archive.folder}/{f}").read() for f in os.listdir(archive.folder) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC-Record-ID") == len(pages())


def test_damage_is_found(spark, written):
    frame, archive = written
    captures = warc.lookup(archive, frame, page_id="page_id")
    with pytest.raises(Exception, match="no response of page"):
        warc.resolved(captures.where("record_type = 'revisit'")).collect()
    with pytest.raises(Exception, match="differs from its digest"):
        warc.resolved(captures.withColumn("payload_digest", captures.url)).collect()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    archive = warc.write(empty)
    assert warc.resolved(warc.lookup(archive, empty, page_id="page_id")).collect() == []
    archive.remove()
