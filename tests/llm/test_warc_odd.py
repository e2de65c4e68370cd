"""WARC records as they come: odd charsets, damaged files, lengths that no file has, headers that are no JSON."""

import gzip
import json

import pytest
from trekspark.llm import warc


def response(spark, content_type, payload, other=None):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + content_type.encode() + b"\r\n\r\n" + payload
    row = ("id", "response", None, None, "u", "d", "t", len(block), "b", None, other, block)
    return spark.createDataFrame([row], warc.FIELDS)


def text_of(spark, *args):
    return {r.warc_type: bytes(r.block).decode() for r in warc.derivatives(response(spark, *args)).collect()}


@pytest.mark.parametrize(("charset", "payload"), [("undefined", "Grün"), ("idna", "Grün"), ("punycode", "Grün"), ("rot13", "Grün"), ("zip", "Grün"), ("no-such", "Grün"), ("windows-1252", "Grün"), ("utf-16", "Grün"), ("gb18030", "绿色"), ("windows-874", "สี"), ("macintosh", "Grün")])
def test_charsets(charset, payload):
    name = warc.charset_of([("Content-Type", f'text/html; charset="{charset}"')])
    assert warc.decoded(payload.encode(name), name) == payload


def test_every_listed_charset_decodes():
    for name in warc.CHARSETS:
        assert isinstance(warc.decoded(b"abc\xff", warc.charset_of([("content-type", f"text/html;charset={name}")])), str)


def test_odd_charset_and_headers_pass_through_spark(spark):
    got = text_of(spark, "text/html; charset=undefined", "<p>Grün</p>".encode(), "not json {")
    assert got["conversion"] == "Grün" and json.loads(got["metadata"])["warc"]["other_headers"] == "not json {"
    assert json.loads(text_of(spark, "text/html", b"x", "[1]")["metadata"])["warc"]["other_headers"] == "[1]"


def test_truncated_and_damaged_files(spark, tmp_path):
    record = {"record_id": "<a>", "warc_type": "resource", "content_length": 40000, "block": bytes(range(256)) * 156 + b"x" * 64}
    whole = gzip.compress(warc.serialized(record)) + gzip.compress(warc.serialized(record | {"record_id": "<b>"}))
    for name, data in (("cut", whole[:-30]), ("bad", whole[:-60] + b"\x00" * 20 + whole[-40:]), ("whole", whole)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "f.warc.gz").write_bytes(data)
        got = warc.read_warc(spark, str(folder)).collect()
        assert got[0].record_id == "<a>" and bytes(got[0].block) == record["block"]
        assert [r.record_id for r in got] == ["<a>", "<b>"] if name == "whole" else len(got) <= 2


def test_lengths_that_no_file_has():
    make = lambda n: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: " + n + b"\r\n\r\nabc"
    for digits in (b"9" * 25, b"1" * 5000, b"-5", b"x"):
        assert list(warc.parsed(make(digits))) == []
    assert [(r["content_length"], r["block"]) for r in warc.parsed(make(b"9" * 18))] == [(10**18 - 1, b"abc")]
