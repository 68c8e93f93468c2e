import glob
import gzip
import os
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from cairnflow.llm import warc


class Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{x}</style><script>var t="</p>";</script></head>
<body><!-- <p>no</p> --><p>Un&nbsp;deux <b>tr</b>ois</p><ul><li><a href="/x?a=1&amp;b=2">X</a></li></ul>caf&eacute; 3 < 4</body></html>"""


def test_text_matches_a_parser_word_by_word():
    p = Words()
    p.feed(PAGE)
    assert "".join(warc.plain_text(PAGE).split()) == "".join("".join(p.out).split())
    assert warc.plain_text(PAGE).split("\n")[:2] == ["A & B", "Un deux trois"]


def test_records_are_linked(spark):
    df = spark.createDataFrame([(1, "http://h.example/p/", PAGE, {"ETag": "q"})], "page_id long, url string, html string, head map<string,string>")
    meta, text = sorted(warc.derivatives(df, "page_id", "url", "html", headers="head").collect(), key=lambda r: r["warc_type"], reverse=True)
    assert (meta["warc_type"], text["warc_type"]) == ("metadata", "conversion")
    assert meta["refers_to"] == text["refers_to"] != meta["record_id"] != text["record_id"]
    assert meta["payload_digest"] == text["payload_digest"] == warc.digest(PAGE.encode())
    assert "outlink: http://h.example/x?a=1&b=2\r\n" in meta["block"] and "source-etag: q" in meta["block"] and "language: fr" in meta["block"]
    assert text["block_digest"] == warc.digest(text["block"].encode()) and text["content_length"] == len(text["block"].encode())


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE) for i in range(3)], "page_id long, url string, html string")
    warc.write_warc(warc.derivatives(df, "page_id", "url", "html"), str(tmp_path / "w"))
    raw = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w/*.gz")))
    n = 0
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert raw[size : size + 4] == b"\r\n\r\n"
        raw, n = raw[size + 4 :], n + 1
    assert n == 6


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, "::bad", "<script>never ends"), (3, "::bad", "<script>never ends"), (None, "u", "<p>" + "long " * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.derivatives(df, "page_id", "url", "html").collect()
    assert len(got) == 10
    assert all(r["block"] == "" for r in got if r["warc_type"] == "conversion" and r["page_id"] in (1, 2, 3))
    assert warc.derivatives(df.where("false"), "page_id", "url", "html").count() == 0


def test_quotes_comments_and_scripts():
    page = """<a title="x > y" href="/z">link</a><p data-x="a>b">Hi</p><!-- <a href="/no"> --><script>"<a href='/no'>"</script>
<a href=/w>w</a><A HREF='/v?a=1&amp;b=2' href="/second">v</a> it's <b class='c>d'>bold</b> 5 > 4 <a name="q">none</a><svg/>after <p title="open>rest"""
    text, _, _, links = warc.read(page, "http://h.example/")
    assert links == ["http://h.example/z", "http://h.example/w", "http://h.example/v?a=1&b=2"]
    assert text == "link\nHi\nwv it's bold 5 > 4 noneafter\nrest"
    assert warc.read("<a " + "=\"x\" " * 5000, "")[3] == []  # ends in no time


def test_header_values_hold_no_line_ends(spark):
    df = spark.createDataFrame([(1, "http://h.example/\r\nX: y", PAGE, {"E\nTag": "q\r\nWARC-Type: response"})], "page_id long, url string, html string, head map<string,string>")
    records = warc.derivatives(df, "page_id", "url", "html", headers="head")
    for r in warc.serialized(records).collect():
        head = r["record"].partition("\r\n\r\n")[0].split("\r\n")
        assert not any(x.startswith(("X:", "WARC-Type: response", "Tag")) for x in head) and not any("\n" in x for x in head)
    meta = records.where("warc_type = 'metadata'").first()["block"]
    assert "source-e tag: q WARC-Type: response\r\n" in meta


class Reader(HTMLParser):
    """Texts, titles and links by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.silent = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in warc.SILENT.split("|")
        if tag == "a" and "href" in dict(attrs) and not self.silent:
            self.links.append(next(v for k, v in attrs if k == "href") or "")

    def handle_endtag(self, tag):
        self.silent -= tag in warc.SILENT.split("|")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_all_pages_equal_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r["page_id"], r["warc_type"]): r for r in warc.op7_warc_derivatives(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == 2 * len(rows)
    for r in rows:
        p = Reader()
        p.feed(r["html"] or "")
        p.close()
        assert "".join(got[r["page_id"], "conversion"]["block"].split()) == "".join("".join(p.out).split())
        links = [x.partition(": ")[2] for x in got[r["page_id"], "metadata"]["block"].split("\r\n") if x.startswith("outlink: ")]
        assert links == [urljoin(r["url"] or "", x.strip()) for x in p.links]
        assert got[r["page_id"], "conversion"]["payload_digest"] == warc.digest((r["html"] or "").encode())
