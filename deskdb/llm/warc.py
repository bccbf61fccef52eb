"""WARC derivatives: metadata and plain-text conversion records from responses.

``responses`` makes response records of pages; ``derive`` makes of each response a metadata record (application/warc-fields:
the response's HTTP status and headers, title, links) and a conversion record (text/plain). Both point back to the response by
WARC-Refers-To, with its target URI and date and the source's digests; their own ids follow from the source's id, so a
rerun makes the same records. ``serialise`` and ``parse`` turn records into WARC/1.1 bytes and back. Every row is independent: there is no
shuffle, and memory is bounded by the largest page.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, spread

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "deskdb:warc")
HTTP_TYPE, FIELDS_TYPE, TEXT_TYPE = "application/http; msgtype=response", "application/warc-fields", "text/plain"

_HIDDEN = frozenset("script style noscript template svg iframe".split())
#: What may be markup: a comment, a tag, a declaration.
_OPEN = re.compile(r"<(?:(?P<note>!--)|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _HIDDEN}
_ZEROS = re.compile(r"(&#[xX]?)0{8,}(?=[0-9a-fA-F])")
_BEYOND = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")
#: Elements that begin a new line of text.
_BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


def unescape(raw: str) -> str:
    """html.unescape, which fails on numbers of thousands of digits."""
    return html.unescape(_BEYOND.sub("\ufffd", _ZEROS.sub(r"\1", raw)) if "&#" in raw else raw)


class _Ends:
    """Where tags end: behind the first ``>`` outside quotes. Once a tag has none, all ends are worked out, from the back, so that a page is read once."""

    def __init__(self, page: str) -> None:
        self.page, self.marks, self.ends = page, None, []

    def of(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``; -1 if it doesn't end."""
        if self.marks is None:
            if m := _REST.match(self.page, at):
                return m.end()
            self._all()
        k = bisect_left(self.marks, at)
        return self.ends[k]

    def _all(self) -> None:
        self.marks = [m.start() for m in re.finditer("[>\"']", self.page)]
        self.ends = [-1] * (len(self.marks) + 1)
        behind = {}  # quote -> number of the next such mark
        for k in range(len(self.marks) - 1, -1, -1):
            kind = self.page[self.marks[k]]
            if kind == ">":
                self.ends[k] = self.marks[k] + 1
            else:
                self.ends[k] = self.ends[behind[kind] + 1] if kind in behind else -1
                behind[kind] = k


def read_html(page: str) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(title, text in lines, links as (element@attribute, address)), in time that follows the page's length.

    Markup that is cut short counts as far as it goes: a tag that doesn't end is text, a comment or hidden element that doesn't end reaches to the page's end.
    """
    out: list[str] = []
    titles: list[str] = []
    links: list[tuple[str, str]] = []
    in_title, at, find, ends, last = False, 0, 0, _Ends(page), page.rfind(">")

    def words(raw: str) -> None:
        if raw:
            raw = unescape(raw)
            out.append(raw)
            if in_title:
                titles.append(raw)

    while m := _OPEN.search(page, find):
        tag = (m["tag"] or "").lower()
        find = m.end()
        if m["note"]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif tag:
            end = ends.of(m.end())
        else:
            end = page.find(">", m.end()) + 1 if m.end() <= last else -1
        if end < 0:
            continue
        words(page[at : m.start()])
        hidden = tag in _HIDDEN and not m["end"]
        if tag in _LINKS and not m["end"]:
            for a in _ATTR.finditer(page, m.end(), end):
                if a[1].lower() == _LINKS[tag]:
                    links.append((f"{tag}@{_LINKS[tag]}", unescape(a[2] or a[3] or a[4] or "").strip()))
                    break
        if hidden:
            close = _CLOSE[tag].search(page, end)
            end = close.end() if close else len(page)
        if tag == "title":
            in_title = not m["end"]
        if tag in _BREAKS:
            out.append("\n")
        elif hidden or tag in ("img", "input", "button", "select"):
            out.append(" ")
        at = find = end
    tail = page[at:]
    words(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!]", tail[tail.rfind(">") + 1 :]) else tail)
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return " ".join("".join(titles).split()) if any(titles) else None, "\n".join(x for x in lines if x), links


def response_block(page: str) -> tuple[bytes, bytes]:
    """(HTTP head, body) of a page."""
    body = page.encode()
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode(), body


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body); a block without a blank line is all head."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(a.strip(), b.strip()) for a, s, b in (x.partition(":") for x in lines) if s], body


def _field(value: str) -> str:
    return " ".join(value.split())


def derivatives(source: dict) -> list[dict]:
    """The metadata and conversion records of one response (record_id, target_uri, warc_date, block, block_digest, payload_digest)."""
    status, headers, body = split_http(source["block"])
    charset = next((m[1] for k, v in headers if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w-]+)", v))), "utf-8")
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    title, text, links = read_html(page)
    uri = source["target_uri"] or ""
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers)]
    fields += [("source-block-digest", source["block_digest"]), ("source-payload-digest", source["payload_digest"])]
    fields += [("title", title)] * (title is not None)
    for how, to in links:
        try:
            to = urljoin(uri, to)
        except ValueError:  # an address that can't be read stays as it is
            pass
        fields.append(("outlink", f"{to} {how}"))
    blocks = (("metadata", FIELDS_TYPE, "".join(f"{k}: {_field(v)}\r\n" for k, v in fields).encode()), ("conversion", TEXT_TYPE, text.encode()))
    return [
        {
            "record_type": kind, "record_id": record_id(source["record_id"], kind), "refers_to": source["record_id"], "target_uri": source["target_uri"], "warc_date": source["warc_date"],
            "content_type": mime, "block": block, "block_digest": digest(block), "source_block_digest": source["block_digest"], "source_payload_digest": source["payload_digest"], "n_links": len(links),
        }
        for kind, mime, block in blocks
    ]


def serialise(record: dict) -> bytes:
    """One WARC/1.1 record."""
    head = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"])]
    if record.get("target_uri"):
        head.append(("WARC-Target-URI", _field(record["target_uri"])))
    if record.get("refers_to"):
        head += [("WARC-Refers-To", record["refers_to"]), ("WARC-Refers-To-Date", record["warc_date"])]
        if record.get("target_uri"):
            head.append(("WARC-Refers-To-Target-URI", _field(record["target_uri"])))
        head += [("WARC-Source-Block-Digest", record["source_block_digest"]), ("WARC-Source-Payload-Digest", record["source_payload_digest"])]
    head += [("WARC-Block-Digest", record["block_digest"])] + [("WARC-Payload-Digest", d) for d in [record.get("payload_digest")] if d]
    head += [("Content-Type", record["content_type"]), ("Content-Length", str(len(record["block"])))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; raises ValueError where a record is cut short or its block digest is wrong."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no record head")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("record cut short")
        if headers.get("WARC-Block-Digest", digest(block)) != digest(block):
            raise ValueError("block digest is wrong")
        yield headers, block
        at = end + 8 + n


SOURCE = {"page_id": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "warc_date": pa.string(), "content_type": pa.string(), "block": pa.binary(), "block_digest": pa.string(), "payload_digest": pa.string()}
DERIVED = {"page_id": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "warc_date": pa.string(), "content_type": pa.string(), "block": pa.binary(), "block_digest": pa.string(), "source_block_digest": pa.string(), "source_payload_digest": pa.string(), "n_links": pa.int64()}


def _schema(kinds: dict) -> str:
    return ", ".join(f"{k} {dict(string='string', int64='long', binary='binary')[str(t)]}" for k, t in kinds.items())


def _batches(kinds: dict, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                rows = [x for r in b.slice(lo, 128).to_pylist() for x in make(r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return run


def _response(row: dict) -> list[dict]:
    head, body = response_block(row["html"] or "")
    uri = row["url"]
    return [{"page_id": row["page_id"], "record_type": "response", "record_id": record_id(row["page_id"], uri, digest(body)), "target_uri": uri, "warc_date": DATE, "content_type": HTTP_TYPE, "block": head + body, "block_digest": digest(head + body), "payload_digest": digest(body)}]


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each page (page_id, url, html). Null html is an empty body, a null url leaves the target out."""
    return spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(_batches(SOURCE, _response), _schema(SOURCE))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response, with the source's page_id; records of other types are passed over.

    Repeated responses give repeated records with equal ids. An empty body gives an empty text and no links. Other columns are ignored.
    """
    own = records.filter("record_type = 'response'").select("page_id", "record_id", "target_uri", "warc_date", "block", "block_digest", "payload_digest")
    return own.mapInArrow(_batches(DERIVED, lambda r: [{"page_id": r["page_id"], **d} for d in derivatives(r)]), _schema(DERIVED))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(documents(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", F.length("block").cast("long").alias("n_bytes"), F.crc32("block").alias("block_crc32"), "block_digest", "source_block_digest", "source_payload_digest", "n_links")


QUERIES = {"op2_warc_derivatives": op2_warc_derivatives}
ORACLE: dict = {}
