import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import warc


@given(st.binary(max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_chunks(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_chunk_extensions_and_damage():
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nX: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")


def test_records_parse_back():
    parts = warc.segments("urn:x-page:1:0-0", b"\r\n\r\nWARC/1.1\r\n" * 9, 50, WARC_Target_URI="http://a")
    blob = b"".join(p + b"\r\n" for p in parts)
    for data in (blob, gzip.compress(blob), b"".join(gzip.compress(p + b"\r\n") for p in parts)):
        got = list(warc.parse(data))
        assert b"".join(b for _, b in got) == b"\r\n\r\nWARC/1.1\r\n" * 9
        assert [h.get("warc-segment-number") for h, _ in got] == [str(i + 1) for i in range(len(parts))]
        assert got[-1][0]["warc-segment-total-length"] == str(14 * 9)


def test_round_trip(spark):
    rows = [(3, "http://a b", "é" * 9000), (1, None, None), (2, "u", ""), (7, "u", "same"), (5, "u", "same"), (5, "u", "same"), (None, "u", "same"), (None, "u", "only unnamed"), (9, "u", "x" * 4096), (10, "u", "\r\n0\r\n\r\nWARC/1.1\r\n" * 900)]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    wanted = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and (i is None or i > first)
        wanted.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, wanted))
    assert {r["payload"].decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_references_resolve_and_ids_stay(spark, tmp_path):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i} " * 700) for i in range(40)] + [(1, "u1", "same"), (3, "u3", "own 3 " * 700), (3, "v", "own 3 " * 700), (None, "u", "same"), (None, "u", "same")]
    ids = []
    for n, parts in enumerate((2, 5)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/{n}")
        heads = [h for f in (tmp_path / str(n)).glob("part-*") for h, _ in warc.parse(f.read_bytes())]
        named = [h["warc-record-id"] for h in heads]
        assert len(named) == len(set(named)) and len({h.get("warc-segment-origin-id", h["warc-record-id"]) for h in heads}) == len(rows)
        kinds = {h["warc-record-id"]: h["warc-type"] for h in heads}
        referred = [h["warc-refers-to"] for h in heads if "warc-refers-to" in h]
        assert len(referred) == sum(h["warc-type"] == "revisit" for h in heads) > 20 and {kinds[r] for r in referred} == {"response"}
        assert {h["warc-segment-origin-id"] for h in heads if "warc-segment-origin-id" in h} <= {*named}
        ids.append(sorted(named))
    assert ids[0] == ids[1]


def test_very_long_page(spark):
    text = "".join(chr(97 + i % 26) for i in range(5_000_000))
    got = warc.round_trip(spark.createDataFrame([(1, text, 2)], "page_id long, html string, `a.b` int")).collect()
    assert len(got) == 1 and got[0]["payload_bytes"] == len(text) and got[0]["payload"].decode() == text


def test_missing_segment_fails(spark, tmp_path):
    parts = warc.segments("urn:x-page:1:0-0", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100, 40, WARC_Payload_Digest="sha1:X")
    (tmp_path / "part-0.warc").write_bytes(b"".join(p + b"\r\n" for p in parts[:-1]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
