"""Operators over pages: URL filters and WARC archives."""

from __future__ import annotations

import gzip
import io
import re

import pytest
from pyspark.sql import functions as F

from reactorlake.llm import common, url_filter, warc
from tests.llm import brute

URLS = [
    (1, "http://Tion.EXAMPLE.net/en/7817?utm=feed"), (2, "https://example.net/en"), (3, "https://xexample.net/en/1"), (4, "http://a.example.com/de/"),
    (5, "http://a.example.org/fr/1#x"), (6, "http://org/fr/"), (7, "http://net"), (8, "http://net/?x"), (9, "no scheme"), (10, None), (11, ""),
    (12, "http://m.casino-win.example.com/en/1"), (13, "http://casinos.example.com/en/1"), (14, "x://y://net/"), (15, "http://example.net:80/en/1"),
    (16, "http://h.example.com\n/de/x"), (17, "ftp://k.NET/EN/"), (12, "http://m.casino-win.example.com/en/1"), (None, "http://a.net/"),
]
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string").withColumn("rule", F.lit("clash"))


def test_listed_rules_decide_as_written(pages):
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(URLS)
    want = {i: verdict(u) for i, u in URLS}
    for r in rows:
        host, path, rule, v = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (v or ("block" if r.page_id == 12 else "allow"))
        assert (r.pattern is not None) == (r.page_id == 12)
    assert url_filter.judge(pages.filter("false")).count() == 0


def test_rules_without_tokens_and_many_rules(pages, monkeypatch):
    rules = (*url_filter.RULES, url_filter.Rule("ends", "block", "/1$", (), False))
    got = {r.page_id: (r.verdict, r.pattern) for r in url_filter.judge(pages, rules).collect()}
    assert got[13] == ("block", "ends") and got[2] == ("block", None)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert {r.page_id: (r.verdict, r.pattern) for r in url_filter.judge(pages, rules).collect()} == got


def html_rows():
    rows = [(i, f"http://a/{i}", f"<html>{'x' * (i % 5)}é</html>") for i in range(20)]
    return [*rows, (20, None, None), (21, "http://b/\r\nX: y", ""), (None, "u", "<html>é</html>"), (19, "again", f"<html>{'x' * 4}é</html>"), (22, "long", "long " * 300_000), (None, None, "alone")]


@pytest.fixture(scope="module")
def archives(spark):
    pages = spark.createDataFrame(html_rows(), "page_id long, url string, html string").withColumn("keep", F.lit("clash")).repartition(3)
    return warc.write_archives(pages, common.fresh_folder(spark, "warc-test"), archive_bytes=600)


def test_archives_read_back_whole(archives):
    rows = warc.read_archives(archives, with_payload=True).collect()
    assert all(r.reason is None for r in rows) and len(rows) == len(html_rows()) == archives.agg(F.sum("records")).first()[0]
    best = {}
    for i, _, h in html_rows():
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    by_key = {}
    for i, _, h in html_rows():
        by_key.setdefault((i, brute.sha1_32((h or "").encode())), h or "")
    for r in rows:
        h = by_key[(r.page_id, r.payload_digest)]
        keep = best.get(h)
        first = keep is None or r.page_id == keep
        assert r.payload_bytes == len(h.encode()) and r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else keep)
        assert r.payload.decode() == (h if first else "")
    assert archives.count() > 3
    assert warc.write_archives(archives.sparkSession.createDataFrame([], "page_id long, url string, html string"), common.fresh_folder(archives.sparkSession, "warc-none")).count() == 0


def test_pages_with_odd_and_long_addresses_are_read_back(spark, tmp_path, monkeypatch):
    urls = ["http://a/\ufffd\ufffdx", "http://b/é", "data:text/html," + "x" * 100_000, "http://c/" + " " * 40_000, "http://d/"]
    rows = [(i, u, f"<p>{i % 3}</p>") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect()}
    assert got == {0: ("revisit", 3), 1: ("revisit", 4), 2: ("response", None), 3: ("response", None), 4: ("response", None)}
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda paths: read(paths).filter("page_id != 2"))
    with pytest.raises(RuntimeError, match="5 records were written, 4 can be read back"):
        warc.op6_warc(spark, str(tmp_path))


def records(n):
    return [gzip.compress(warc.build_record(i, f"http://a/{i}", b"payload %d " % i * 50, None, "2024-01-01T00:00:00Z")) for i in range(n)]


def salvaged(data):
    return [(a, b, reason, [r.headers["x-page-id"] for r in rs]) for a, b, reason, rs in warc.salvage(io.BytesIO(data), len(data))]


def test_salvage_finds_every_record_behind_damage():
    parts = records(6)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    data = bytearray(b"".join(parts))
    data[starts[2] + 40] ^= 0xFF  # a flipped bit inside a member
    data[starts[4] : starts[4] + 3] = b"\0\0\0"  # a lost member start
    got = salvaged(bytes(data))
    assert [x for *_, ids in got for x in ids] == ["0", "1", "3", "5"]
    assert [(a, b) for a, b, reason, _ in got if reason] == [(starts[2], starts[3]), (starts[4], starts[5])]
    assert salvaged(b"".join(parts)[:-10])[-1][:2] == (starts[5], starts[6] - 10)
    assert sum(b - a for a, b, *_ in got) == len(data)


def test_salvage_of_uncompressed_and_mixed_archives(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    plain = [gzip.decompress(r) for r in records(3)]
    data = b"junk WARC/1.7 junk" + plain[0] + plain[1][:100] + records(1)[0] + plain[2] + b"\x1f\x8b\x08tail"
    got = salvaged(data)
    assert [x for *_, ids in got for x in ids] == ["0", "0", "2"]
    assert [data[a:b][:4] for a, b, reason, _ in got if reason] == [b"junk", b"WARC", b"\x1f\x8b\x08t"]
    wrong = plain[0].replace(b"payload 0", b"payload 9", 1)
    assert [reason for _, _, reason, _ in salvaged(wrong + plain[1])] == ["block digest", None]
    assert salvaged(b"") == []


def test_gaps_are_reported_by_the_reader(spark, tmp_path):
    data = bytearray(b"".join(records(3)))
    data[5] ^= 0xFF
    data[len(records(1)[0]) + 50] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    rows = warc.read_archives(paths).collect()
    assert [r.page_id for r in rows if r.reason is None][-1] == 2
    gaps = [r for r in rows if r.reason]
    assert gaps and all(r.stop > r.start and r.page_id is None for r in gaps)


def test_salvage_inside_a_member():
    plain = [gzip.decompress(r) for r in records(4)]
    bad = plain[1].replace(b"payload 1", b"payload 7", 1)
    member = gzip.compress(plain[0] + bad + plain[2] + b"noise" + plain[3])
    data = member + records(1)[0]
    got = salvaged(data)
    assert [x for *_, ids in got for x in ids] == ["0", "2", "3", "0"]
    a, b = len(plain[0]), len(plain[0]) + len(bad)
    c = b + len(plain[2])
    assert [(x, y, why) for x, y, why, _ in got if why] == [(0, len(member), f"block digest (bytes {a} to {b} of the member)"), (0, len(member), f"version line (bytes {c} to {c + 5} of the member)")]


def test_salvage_of_a_member_that_ends_badly():
    plain = [gzip.decompress(r) for r in records(4)]
    member = gzip.compress(b"".join(plain))
    cut = salvaged(member[:-12] + records(1)[0])
    assert [x for *_, ids in cut for x in ids][:3] == ["0", "1", "2"] and [x for *_, ids in cut for x in ids][-1] == "0"
    assert all(reason for *_, reason, ids in cut if not ids) and cut[0][:2] == (0, len(member) - 12)
    wrong = bytearray(member)
    wrong[-6] ^= 1  # the checksum
    assert [x for *_, ids in salvaged(bytes(wrong)) for x in ids] == ["0", "1", "2", "3"]
    # without a digest nothing vouches for a record of a damaged member
    bare = re.sub(rb"WARC-(Payload|Block)-Digest: \S+\r\n", b"", plain[0])
    member = gzip.compress(bare)
    assert [ids for *_, ids in salvaged(member)] == [["0"]] and salvaged(member[:-4])[0][3] == []


SYNTAX = ["! a comment", "[heading]", "", "*", "||ads.example.com^", "||Track", "|http", "banner*.gif|", "/ad/", "@@||good.net^", "a.b-c", "^promo^", "||x*y^z"]
SUBJECTS = ["ads.example.com/", "xads.example.com/", "m.ads.example.com/x", "ads.example.commerce/", "tracker.net/", "nottrack.net/", "h.net/banner/1.GIF", "h.net/banner.gif?", "h.net/ad/1", "h.net/AD/1", "h.net/bad/", "good.net/", "a.b-c", "aa.b-cc", "h/promo/x", "h/promotion", "h/promo", "xqy/z", "a.xqqy/z", ""]


def test_patterns_and_their_tokens():
    rules = {r.name: r for r in url_filter.parse_rules(SYNTAX + SYNTAX)}
    assert list(rules) == SYNTAX[4:]
    fits = lambda name: {s for s in SUBJECTS if re.search(rules[name].regex, s)}
    assert fits("||ads.example.com^") == {"ads.example.com/", "m.ads.example.com/x"}
    assert fits("||Track") == {"tracker.net/"} and fits("/ad/") == {"h.net/ad/1", "h.net/AD/1"} and fits("^promo^") == {"h/promo/x", "h/promo"}
    assert fits("banner*.gif|") == {"h.net/banner/1.GIF"} and fits("||x*y^z") == {"xqy/z", "a.xqqy/z"} and rules["@@||good.net^"].verdict == "allow"
    assert rules["||ads.example.com^"].tokens == ("ads", "example", "com") and rules["||Track"].tokens == () and rules["a.b-c"].tokens == ("b",)
    assert rules["banner*.gif|"].tokens == ("gif",) and rules["||x*y^z"].tokens == ()
    for r in rules.values():  # every matching address holds every token
        for s in fits(r.name):
            assert set(r.tokens) <= set(re.split("[^a-z0-9]+", s.lower()))


def test_ten_thousand_patterns_decide_as_all_of_them_tried(spark):
    lines = [f"||host{i}.example.com^" for i in range(9000)] + [f"/path{i}/*.js|" for i in range(900)] + [f"@@||host{i}.example.com^free^" for i in range(0, 9000, 90)]
    rules = url_filter.parse_rules(lines)
    assert len(rules) == 10_000
    urls = [f"http://{'www.' * (i % 2)}host{i * 7}.example.com/{'free' if i % 3 else 'x'}/" for i in range(400)] + [f"http://h/path{i}/{'a' * 40_000 if i == 3 else 'a'}.js" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in url_filter.judge(pages, rules).collect()}
    compiled = [(re.compile(r.regex), r.name, r.verdict) for r in rules]
    for i, u in enumerate(urls):
        hits = [(name, v) for regex, name, v in compiled if regex.search(u.split("://", 1)[1])]
        assert got[i] == ((max(hits)[1], max(hits)[0]) if hits else ("allow", None)), (i, u, hits)
