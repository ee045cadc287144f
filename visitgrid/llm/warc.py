"""WARC archives, index first.

Writing returns an index: one row per record with its archive, offset, length, URL and digest.
Reading sorts the selected index rows by archive and offset, joins neighbouring byte ranges into
one read and cuts the records out of it. Of records with equal payloads of at least ``MIN_SHARED``
bytes, the one with the smallest id is the response; the others are revisits that refer to it and
carry no payload.

Each writing task makes files of its own under a name never used before, and the index holds the
rows of the attempts that were committed: a task that is run again leaves unreferenced files only.
The folder may be on any store that ``pyarrow.fs`` opens.

Defined cases: a null payload is empty; short payloads are always responses; a null URL is empty
and line breaks in a URL are percent-encoded; repeated rows with one id and one payload are all
responses, or all revisits of a smaller id; a row without an id can only be a revisit or stand
alone. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.plans.ordered import checkpoint_dir, materialize

MIN_SHARED = 100
#: A new archive begins after this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most so far apart are read together, up to so many bytes at once.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: Pages carry no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri)


def with_types(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, record_type and refers_to.

    Only (digest, id) is aggregated; digests that occur once never leave that step, so the table
    joined to the pages holds shared digests alone.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
                        F.sha2(html, 256).alias("digest"))
    shared = materialize(rows.where(F.octet_length("html") >= MIN_SHARED).groupBy("digest")
                         .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                         .where((F.col("n") > 1) & F.col("first_id").isNotNull())
                         .select(F.col("digest").alias("shared_digest"), "first_id"))
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
            .select("page_id", "url", "html", "digest", F.when(later, "revisit").otherwise("response")
                    .alias("record_type"), F.when(later, F.col("first_id")).alias("refers_to")))


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record.

    The digest of a response is computed anew from its payload and must be the recorded one.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if first != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")

    def number(field):
        text = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    return number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page as a record and returns the written index."""

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, k = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", None, 0, 0
        try:
            for b in batches:
                rows = []
                ids = [None if pd.isna(x) else int(x) for x in b["page_id"]]
                refs = [None if pd.isna(x) else int(x) for x in b["refers_to"]]
                for page, url, html, digest, kind, ref in zip(ids, b["url"], b["html"], b["digest"],
                                                              b["record_type"], refs):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, at, k = f"{name}-{k:04d}.warc", 0, k + 1
                        out = fs.open_output_stream(f"{root}/{path}")
                    safe = url.replace("\r", "%0D").replace("\n", "%0A")
                    data = record(page, safe, html.encode("utf-8", "surrogatepass"), digest, kind, ref)
                    out.write(data)
                    rows.append((path, at, len(data), url, digest, kind, page))
                    at += len(data)
                index = pd.DataFrame(rows, columns=["archive", "offset", "length", "url", "digest",
                                                    "record_type", "page_id"])
                yield index.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return materialize(with_types(pages).mapInPandas(run, INDEX))


def read_records(selected: DataFrame, folder: str, gap: int = GAP, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of the selected index rows, one row each."""

    def run(batches):
        fs, root = _open(folder)
        path, source = None, None
        for b in batches:
            rows, k, n = [], 0, len(b)
            archive, offset, length = b["archive"].tolist(), b["offset"].tolist(), b["length"].tolist()
            while k < n:
                first, end, last = k, offset[k] + length[k], k + 1
                while (last < n and archive[last] == archive[first] and offset[last] - end <= gap
                       and offset[last] + length[last] - offset[first] <= read_bytes):
                    end = max(end, offset[last] + length[last])
                    last += 1
                if archive[first] != path:
                    path, source = archive[first], fs.open_input_file(f"{root}/{archive[first]}")
                source.seek(offset[first])
                data = source.read(end - offset[first])
                for i in range(first, last):
                    lo = offset[i] - offset[first]
                    rows.append(parse(data[lo:lo + length[i]]))
                k = last
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return (selected.select("archive", "offset", "length").repartitionByRange("archive", "offset")
            .sortWithinPartitions("archive", "offset").mapInPandas(run, RECORDS))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads every record back through the index."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, folder), folder)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest,
                  min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_SHARED} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_SHARED} AND page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
