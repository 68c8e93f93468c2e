"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives two records that refer to it: a `metadata` record with its title, language, outlinks
and source headers as warc-fields, and a `conversion` record with the plain text of its payload. Both keep the
response's record id (WARC-Refers-To), target URI, date, source headers and payload digest, and carry a digest
of their own block. Records are made row by row, without a shuffle.

Defined cases: a null payload or URI is an empty one; an empty payload gives empty text and no links; equal rows
give equal records; responses without an id get one from a digest of key, URI and payload; payloads of any
length are read whole; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.arrow import parts

RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers string, payload_digest string, block_digest string, content_length long, block string"
)
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")])

# Fixed lists: elements without readable text, elements that end a line.
SILENT = "script|style|noscript|template|svg"
LINES = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"

# What stands between a tag's name and its end; quotes hold what they enclose only behind an equals sign.
_REST = r"""(?>[^>"'=]+|=\s*+"[^"]*"|=\s*+'[^']*'|[="'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SILENT})(?=[\s/>]){_REST}(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][^\s/>]*)({_REST})>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_LINE = re.compile(rf"(?:{LINES})\Z", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_EDGES = re.compile(r" ?\n[ \n]*")
_BREAKS = re.compile(r"[\r\n]+")


def _attribute(rest: str, name: str) -> str | None:
    """The value of a tag's first attribute of that name."""
    for m in _ATTRIBUTE.finditer(rest):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "").strip()
    return None


def _tidy(text: str) -> str:
    return _EDGES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def read(page: str, base: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links) in one pass: comments and silent elements have none of them. The text has a line per
    block element and single spaces; links are resolved against the base, in order."""
    out, to, at, title, lang = [], [], 0, None, ""
    for m in _TOKEN.finditer(page):
        out.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if _LINE.match(name):
            out.append("\n")
        if name == "title":
            if not m[2] and title is None:
                title = len(out)
            elif m[2] and type(title) is int:
                title = "".join(out[title:])
        elif m[2]:
            continue
        elif name == "a" and (found := _attribute(m[4], "href")) is not None:
            try:
                to.append(urljoin(base, found))
            except ValueError:
                to.append(found)
        elif name == "html" and not lang:
            lang = _attribute(m[4], "lang") or ""
    out.append(page[at:])
    return _tidy("".join(out)), _tidy(title).replace("\n", " ") if isinstance(title, str) else "", lang, to


def plain_text(page: str) -> str:
    return read(page, "")[0]


def one_line(text: str) -> str:
    """A header's value, which can't hold line ends."""
    return _BREAKS.sub(" ", text).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def derive(key: int | None, uri: str, page: str, record_id: str | None, date: str, headers: str) -> list[tuple]:
    """The two records of one response."""
    payload = digest(page.encode())
    source = record_id or identifier("response", str(key), uri, payload)
    text, title, lang, links = read(page, uri)
    uri = uri.replace("\n", "%0A").replace("\r", "%0D")
    fields = [("title", title), ("language", one_line(lang))]
    fields += sorted((f"source-{one_line(k).lower()}", one_line(v or "")) for k, v in json.loads(headers or "{}").items())
    fields += [("outlink", x.replace("\n", "%0A").replace("\r", "%0D")) for x in links]
    blocks = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", text))
    out = []
    for kind, content, block in blocks:
        raw = block.encode()
        own = digest(raw)
        out.append((key, kind, identifier(kind, source, own), source, uri, date, content, headers, payload, own, len(raw), block))
    return out


def derivatives(
    responses: DataFrame, key: str, uri: str, payload: str, record_id: str | None = None, date: str | Column = "1970-01-01T00:00:00Z", headers: str | None = None
) -> DataFrame:
    """RECORD rows, two per response. headers names a map of the response's headers; date is a column or one date for all."""

    def run(batches):
        for b in batches:
            for some in parts(b, 2, rows=1000):
                rows = [r for row in zip(*(c.to_pylist() for c in some.columns), strict=True) for r in derive(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return responses.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(uri), F.lit("")).alias("uri"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        (F.col(record_id) if record_id else F.lit(None)).cast("string").alias("record_id"),
        F.coalesce((F.lit(date) if isinstance(date, str) else date).cast("string"), F.lit("")).alias("date"),
        F.coalesce(F.to_json(headers) if headers else F.lit("{}"), F.lit("{}")).alias("headers"),
    ).mapInArrow(run, RECORD)


def serialized(records: DataFrame) -> DataFrame:
    """(record): each record in WARC 1.1 format, without the blank lines that end it."""
    clean = lambda value: F.regexp_replace(value, r"[\r\n]+", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), clean(value), F.lit("\r\n"))
    kept = F.from_json("source_headers", "map<string,string>")
    source = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(F.lit("WARC-X-Source-"), clean(e["key"]), F.lit(": "), clean(e["value"]), F.lit("\r\n"))), "")
    return records.select(
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
            line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Source-Payload-Digest", F.col("payload_digest")),
            line("WARC-Block-Digest", F.col("block_digest")), source, line("Content-Type", F.col("content_type")),
            line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block"),
        ).alias("record")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Compressed WARC files, one per partition, by Spark's own writer, wherever the path leads. A file is one gzip stream."""
    serialized(records).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
