"""Legacy archives that this library did not write: odd lines, bytes, dates, records without HTTP, damage."""

import hashlib
import time
import zlib

import pytest

from plumbline.llm import archives
from plumbline.session import shared_dir


def gz(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def line(url, date, mime, block, version, ip="10.1.2.3"):
    more = b" 200 - - 77 old.arc" if version == 2 else b""
    return b"%s %s %s %s%s %d\n%s\n" % (url, ip.encode(), date, mime, more, len(block), block)


def header(version, text=b"operator: someone\n"):
    fields = archives._FIELDS[version]
    block = b"%d 0 Some Crawler\n%s\n%s" % (version, fields, text)
    return b"filedesc://old.arc 0.0.0.0 19961231 text/plain" + (b" 200 - - 0 old.arc" if version == 2 else b"") + b" %d\n%s\n" % (len(block), block)


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"
RECORDS = [
    (b"http://a/with space/x y", b"19970101123456", b"text/html", HTTP + b"one"), (b"http://a/caf\xe9", b"19970101", b"text/html", HTTP + b"two"), (b"http://a/%41", b"1997", b"text/html", HTTP + b"three"),
    (b"dns:a.net", b"199701011234", b"text/dns", b"19970101\na.net 3600 IN A 10.1.2.3\n"), (b"http://a/lf", b"19970101123456", b"text/html", b"HTTP/1.0 200 OK\nServer: x\n\nfour\n\nmore"),
    (b"http://a/headless", b"19970101123456", b"text/html", b"HTTP/1.0 404 None"), ("http://a/é".encode(), b"19970101123456", b"text/html", HTTP + b"L" * 200), (b"http://a/same", b"19970101123456", b"text/html", HTTP + b"L" * 200),
    (b"dns:b.net", b"19970101123456", b"text/dns", b"L" * 200),
]
TARGETS = ["http://a/with space/x y", "http://a/caf%E9", "http://a/%41", "dns:a.net", "http://a/lf", "http://a/headless", "http://a/é", "http://a/same", "dns:b.net"]
DATES = ["1997-01-01T12:34:56Z", "1997-01-01T00:00:00Z", "1997-01-01T00:00:00Z", "1997-01-01T12:34:00Z"]
PAYLOADS = [b"one", b"two", b"three", RECORDS[3][3], b"four\n\nmore", b"", b"L" * 200, b"L" * 200, b"L" * 200]


def through(spark, files):
    """The rows of the converted files, and the raw records by target."""
    paths = [archives._store(shared_dir(spark, "old"), name, data) for name, data in files.items()]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    made = archives.convert(frame, shared_dir(spark, "new"))
    raw = [r for p in made.collect() for r in archives.parse_warc(archives._load(p.path))]
    return archives.read_warc(made).collect(), raw, archives.rejects(frame).collect()


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, version, packed):
    parts = [header(version), *[line(*r, version) for r in RECORDS]]
    rows, raw, bad = through(spark, {"old.arc": b"".join(map(gz, parts)) if packed else b"".join(parts)})
    by = {r.url: r for r in rows}
    assert sorted(by) == sorted(TARGETS) and not bad and len(raw) == len(rows) + 1
    for target, payload in zip(TARGETS, PAYLOADS, strict=True):
        assert (by[target].payload_bytes, by[target].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest()), target
    assert [by[t].warc_date for t in TARGETS[:4]] == DATES
    kinds = {t: by[t].record_type for t in TARGETS}
    assert kinds["dns:a.net"] == kinds["dns:b.net"] == "resource" and kinds["http://a/headless"] == "response"
    assert kinds["http://a/same"] == "response" and kinds["http://a/é"] == "revisit"  # of equal payloads the first by url; a resource has no part in it
    heads = {h.get("WARC-Target-URI"): (h, b) for h, b in raw}
    info, body = heads[None]
    assert info["WARC-Type"] == "warcinfo" and info["WARC-Date"] == "1996-12-31T00:00:00Z" and b"operator: someone" in body and b"old.arc" in body
    assert all(h["WARC-Warcinfo-ID"] == info["WARC-Record-ID"] and h["WARC-IP-Address"] == "10.1.2.3" for t, (h, _) in heads.items() if t)
    assert heads["dns:a.net"][0]["Content-Type"] == "text/dns" and heads["http://a/é"][0]["WARC-Refers-To"] == heads["http://a/same"][0]["WARC-Record-ID"]


def test_damage_is_rejected_and_the_rest_stays(spark):
    good = [gz(line(*r, 1)) for r in RECORDS[:2]]
    short = gz(b"http://a/short 1.1.1.1 19970101 text/html 500\nfew")
    files = {
        "middle.arc": gz(header(1)) + good[0] + short + gz(b"no length here\n") + gz(line(b"http://d", b"someday", b"text/html", HTTP, 1)) + gz(line(b"http://d", b"19971301", b"text/html", HTTP, 1)) + gz(b"a 19970101 1 3\nabc") + good[1],
        "cut.arc": gz(header(1)) + good[0] + good[1][:-12], "noise.arc": gz(header(1)) + good[0] + b"\x00\x01\x02 noise", "plain.arc": header(1) + line(*RECORDS[0], 1) + b"junk without end",
        "none.arc": b"<html>no archive</html>\n", "empty.arc": b"",
    }
    rows, _, bad = through(spark, files)
    assert sorted(r.url for r in rows) == ["http://a/caf%E9"] + ["http://a/with space/x y"] * 4
    reasons = sorted((b.path.rsplit("/", 1)[1], b.reason.split(":")[0]) for b in bad)
    assert [r for n, r in reasons if n == "middle.arc"] == sorted(["an ARC record is shorter than its declared length", "an ARC line without a length", "an archive date of no digits", "an archive date that is none", "an ARC 1 line of 4 fields"])
    assert [n for n, _ in reasons if n != "middle.arc"] == ["cut.arc", "noise.arc", "none.arc", "plain.arc"]


def test_urls_of_pages_come_back(spark):
    urls = ["http://a/ b", " http://a", "http://a/\r\nX-Page-Id: 9", "-", '""', "", None, "http://a/%2D%41é", "a b", " x", "%2D"]
    df = spark.createDataFrame([(i, u, "x" * 120) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in archives.through_archives(df).collect()}
    assert [rows[i].url for i in range(len(urls))] == urls
    assert {r.refers_to for r in rows.values()} == {None, 0}


def test_members_are_split_in_linear_time():
    def took(n):
        data = gz(b"x" * 1000) * n
        start = time.perf_counter()
        assert sum(len(m) for m in archives.members(data)) == 1000 * n
        return time.perf_counter() - start

    took(2000)
    small, large = min(took(10_000) for _ in range(3)), min(took(40_000) for _ in range(3))
    assert large < 8 * small  # four times the members
