"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

For each response two records are made, both with ``WARC-Refers-To`` naming the response: a ``metadata`` record
(application/warc-fields: the source's WARC identifier, date and digests, its HTTP status and headers, and the page's
title, language, character set and links), and a ``conversion`` record (text/plain, the page's text). Record identifiers
are name-based UUIDs, so equal responses give equal records and reruns agree. Digests are ``sha1:`` in Base32.

Text: tags, comments, and the content of script, style, template, noscript and title go; block elements and ``br`` end a
line; character references are resolved; white space within a line becomes one blank and empty lines go. Chunked and
compressed (gzip, deflate) bodies are undone first; a body that isn't what its headers say is taken as it stands.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import slices, without

#: The date of records made from tables, which have none.
DATE = "2024-01-01T00:00:00Z"
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SILENT = ("script", "style", "template", "noscript", "title")
CLOSING = {n: re.compile(rf"</{n}[\s/>]", re.IGNORECASE) for n in SILENT}
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, parts)))}>"


def page_text(html: str) -> tuple[str, dict[str, str], list[str]]:
    """(text, {title, lang, charset as found}, link targets) of a page, in one pass; malformed markup never fails."""
    out: list[str] = []
    facts: dict[str, str] = {}
    links: list[str] = []
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            out.append(unescape(html[at:]))
            break
        if lt > at:
            out.append(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = TAG.match(html, lt)
        if not tag:
            end = html.find(">", lt) if mark == "/" or mark.isalpha() else -1
            if end < 0:
                out.append("<")
                at = lt + 1
            else:
                at = end + 1
            continue
        at, name, attributes = tag.end(), tag[2].lower(), tag[3]
        if name in BLOCK:
            out.append("\n")
        if tag[1]:
            continue
        if name in SILENT:
            close = CLOSING[name].search(html, at)
            end = close.start() if close else n
            if name == "title" and "title" not in facts:
                facts["title"] = " ".join(unescape(html[at:end]).split())
            at = end
        elif name in ("a", "html", "meta") and attributes:
            values = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            if name == "a" and values.get("href"):
                links.append(values["href"])
            elif name == "html" and values.get("lang"):
                facts.setdefault("lang", values["lang"])
            elif name == "meta" and values.get("charset"):
                facts.setdefault("charset", values["charset"])
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(filter(None, lines)), facts, links


def http_block(html: str | None) -> bytes:
    """The block of a response record for a page of a table."""
    body = (html or "").encode("utf-8", "surrogatepass")
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    return lines[0], headers, body


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, headers, Content-Length, block and the two empty lines that end it."""
    lines = ["WARC/1.1", *[f"{k}: {_line(v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decoded_body(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A body without its transfer and content encodings, the last applied first."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",")]
    for coding in reversed(named("content-encoding") + named("transfer-encoding")):
        try:
            if coding == "chunked":
                body = _dechunked(body)
            elif coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
        except (ValueError, OSError, EOFError, zlib.error):
            break
    return body


def _inflated(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a file: as it is, or gzip member after member, a piece at a time; a broken member ends it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(rest), 1 << 16):
                if piece := member.decompress(rest[at : at + (1 << 16)]):
                    yield piece
                if member.eof:
                    break
        except zlib.error:
            return
        if not member.eof:
            return
        rest = rest[min(at + (1 << 16), len(rest)) - len(member.unused_data) :]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC file, gzipped (by member) or not, one at a time.

    Bytes that are no record give one with the header ``error`` and are passed over up to the next ``WARC/`` on a line of
    its own; a record that the file's end cuts off gives one too.
    """
    pieces, held, ended = _inflated(data), bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        lines = bytes(held[: max(end, 0)]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        if lines[0].startswith("WARC/") and size.isdigit() and fill(end + 4 + int(size)):
            yield headers, bytes(held[end + 4 : end + 4 + int(size)])
            fill(end + 8 + int(size))
            del held[: end + 8 + int(size)]
            continue
        yield {"error": f"not a whole WARC record: {lines[0][:80]!r}"}, b""
        while (next_ := held.find(b"\nWARC/", 1)) < 0 and fill(len(held) + 1):
            pass
        del held[: next_ + 1 if next_ >= 0 else len(held)]


def _line(value: object) -> str:
    return " ".join(str(value).split())


def derive(source_id: str, uri: str | None, date: str, block: bytes, payload_digest: str, block_digest: str) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, http, body = split_http(block)
    body = decoded_body(http, body)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    text, facts, links = page_text(html)
    fields = [
        ("source-record-id", source_id), ("source-date", date), ("source-payload-digest", payload_digest),
        ("source-block-digest", block_digest), ("source-http-status", status), *[(f"source-http-header-{k.lower()}", v) for k, v in http],
        *[(k, facts[k]) for k in ("title", "lang", "charset") if k in facts], ("outlinks", len(links)),
        *[("outlink", x) for x in links],
    ]
    blocks = [
        ("metadata", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", text),
    ]
    out = []
    for warc_type, content_type, content in blocks:
        data = content.encode("utf-8", "replace")
        made = record_id(source_id, warc_type, digest(data))
        headers = [("WARC-Type", warc_type), ("WARC-Record-ID", made), ("WARC-Date", date), ("WARC-Refers-To", source_id)]
        headers += [("WARC-Target-URI", uri)] if uri else []
        headers += [("WARC-Block-Digest", digest(data)), ("Content-Type", content_type)]
        out.append(
            {
                "warc_type": warc_type, "record_id": made, "refers_to": source_id, "target_uri": uri, "warc_date": date,
                "content_type": content_type, "content_length": len(data), "block_digest": digest(data),
                "source_payload_digest": payload_digest, "block": data.decode(),
                "record_sha256": hashlib.sha256(serialize(headers, data)).hexdigest(), "record": serialize(headers, data),
            }
        )
    return out


FIELDS = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, block string, record_sha256 string"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def derivatives(responses: DataFrame, keep: list[str] | None = None, with_record: bool = False) -> DataFrame:
    """Two rows, metadata and conversion, for each row of ``responses`` (record_id, target_uri, warc_date, block, and
    optionally payload_digest and block_digest, which are computed where null or absent).

    Columns in ``keep`` (default: none) are carried, unless a new column has their name. A null block counts as empty, a
    null record id is made from the URI and the block, a null URI gives records without one. Repeated responses give
    repeated records; an empty table gives none; very long pages are taken whole, a few rows at a time. ``with_record``
    adds the whole record's bytes. Map-only.
    """
    import pyarrow as pa

    if "error" in responses.columns:  # of read_responses: no records
        responses = responses.where("error is null")
    names = [*NAMES, *(["record"] if with_record else [])]
    carried = without(responses.select(*[F.col(f"`{c}`") for c in keep or []]), names).columns
    have = responses.columns
    columns = ["record_id", "target_uri", "warc_date", "block", "payload_digest", "block_digest"]
    frame = responses.select(
        *[F.col(f"`{c}`") for c in carried],
        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(f"__r{k}") for k, c in enumerate(columns)],
    )
    before = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema[: len(carried)])
    schema = before + FIELDS + (", record binary" if with_record else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                made: list[dict] = []
                for k in range(batch.num_rows):
                    source, uri, date, block, payload, own = (batch.column(f"__r{i}")[k].as_py() for i in range(6))
                    block = block or b""
                    payload = payload or digest(split_http(block)[2])
                    made += derive(source or record_id(uri, "response", payload), uri, date or DATE, block, payload, own or digest(block))
                twice = pa.array([i // 2 for i in range(len(made))])
                arrays = [batch.column(c).take(twice) for c in carried]
                kinds = {"content_length": pa.int64(), "record": pa.binary()}
                arrays += [pa.array([m[c] for m in made], type=kinds.get(c, pa.string())) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])

    return frame.mapInArrow(run, schema)


def page_responses(pages: DataFrame) -> DataFrame:
    """Response records (record_id, target_uri, warc_date, block) of a table of pages (page_id, url, html); native."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha1(html)))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.concat(head.cast("binary"), html).alias("block"),
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (.warc or .warc.gz) under a path, as ``derivatives`` takes them, and ``error``.

    A file is one row of at most 2 GB, inflated record by record; what is no record gives a row with its ``error`` alone.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for h, block in records(content):
                    if "error" in h or h.get("warc-type") == "response":
                        rows.append((*[h.get(n) for n in names], None if "error" in h else block, h.get("error")))
                    if len(rows) >= 200:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    names = ["warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest"]
    columns = ["record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "block", "error"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("content")
    schema = ", ".join(f"{c} {'binary' if c == 'block' else 'string'}" for c in columns)
    return files.mapInPandas(run, schema)


def write_warc(derived: DataFrame, folder: str) -> DataFrame:
    """Write records (``derivatives(..., with_record=True)``) as one .warc.gz file a task, a gzip member a record.

    Returns the list of files (file, records), which is run to write. A file is renamed into place when it is whole.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"derived-{TaskContext.get().partitionId():06d}.warc.gz"
        attempt, n = f"{base}/.{name}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(attempt, compression=None) as f:
            for frame in frames:
                for data in frame["record"]:
                    f.write(gzip.compress(bytes(data), mtime=0))
                    n += 1
        if n:
            store.move(attempt, f"{base}/{name}")
            yield pd.DataFrame({"file": [name], "records": [n]})
        else:
            store.delete_file(attempt)

    return derived.select("record").mapInPandas(run, "file string, records long")


def query(pages: DataFrame) -> DataFrame:
    return derivatives(page_responses(pages), keep=["page_id"])
