"""WARC archives with revisit records for payloads that occur more than once.

Headers alone are shuffled by payload digest to find each payload's response; revisit records then carry no payload
but refer to it. Reading joins them to their responses again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Payloads below this many bytes are always stored as responses.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"
_id = re.compile(rb"WARC-Record-ID: <urn:page:(-?\d+)>")


def resolve(pages: DataFrame, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, refers_to, refers_to_url (null for responses), without payloads.

    Of pages with equal payloads of at least least_bytes, that with the largest page_id is the response. A null payload
    is an empty one. Rows with a null page_id are responses and nothing refers to them. Rows that share page_id and
    payload are one page; its url is the greatest of theirs.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("_u"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    large = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    # Only digests that do occur again need the join; partial counts keep a hot digest's rows in their own tasks.
    again = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("of"), F.min("page_id").alias("least"), F.max(F.struct("page_id", F.col("_u").alias("u"))).alias("m")).where("of > least").select("payload_digest", "payload_bytes", "of", F.col("m.u").alias("_to"))
    at = F.when(F.col("payload_bytes") >= least_bytes, F.when(F.col("page_id") < F.col("of"), F.col("of")))
    return heads.join(again, ["payload_digest", "payload_bytes"], "left").select("page_id", "payload_bytes", "payload_digest", at.alias("refers_to"), F.when(at.isNotNull(), F.col("_to")).alias("refers_to_url"))


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int, target: str | None) -> bytes:
    """size: bytes of the page's payload, which a revisit does not carry; target: the url of the page that it refers to."""
    name = "none" if page_id is None else str(page_id)
    shown = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    plain = lambda x: re.sub(r"[\r\n]", "", x or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {plain(url)}", f"WARC-Payload-Digest: {shown}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {plain(target)}", f"WARC-Refers-To-Date: {DATE}", "WARC-Truncated: length"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)  # a gzip member for each record
    return gz.compress(data) + gz.flush()


def write(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as gzipped archives under path; returns shard, path, records. A null url is
    about:blank. An empty table gives no archive. Other columns are not read."""
    spark = pages.sparkSession
    C.arrow_rows(spark)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    refs = resolve(pages, least_bytes=least_bytes).where("refers_to is not null").select("page_id", "refers_to", "refers_to_url", "payload_digest").distinct()
    to_write = plain.withColumn("_digest", F.sha1(F.encode("html", "UTF-8"))).join(refs.withColumnRenamed("payload_digest", "_digest"), ["page_id", "_digest"], "left")
    # The payload of a revisit is its digest and length only, from here on.
    to_write = to_write.select("page_id", "url", "_digest", "refers_to", "refers_to_url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("_bytes"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .files import Output

        shard, n = TaskContext.get().partitionId(), 0
        uri, out, stream = f"{path}/pages-{shard:06d}.warc.gz", None, None
        try:
            for b in batches:
                for page_id, url, digest, ref, to, html, size in zip(b.page_id, b.url, b._digest, b.refers_to, b.refers_to_url, b.html, b._bytes):
                    if out is None:
                        stream = (out := Output(uri)).__enter__()
                    page_id, ref = None if pd.isna(page_id) else int(page_id), None if pd.isna(ref) else int(ref)
                    stream.write(_record(page_id, url, (html or "").encode(), digest, ref, int(size), to))
                    n += 1
        except BaseException as error:
            if out is not None:
                out.__exit__(type(error), error, None)
            raise
        if out is not None:
            out.__exit__(None, None, None)
            yield pd.DataFrame({"shard": [shard], "path": [uri], "records": [n]})

    return C.cut(to_write.mapInPandas(save, "shard int, path string, records long"))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive with a gzip member for each record."""
    gz, data = zlib.decompressobj(31), b""
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            if data:
                raise ValueError("the archive ends within a record")
            return
        data += gz.decompress(rest)
        rest = gz.unused_data
        if gz.eof:
            head, _, body = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if first != "WARC/1.1":
                raise ValueError(f"not a record: {first!r}")
            fields = dict(x.split(": ", 1) for x in lines)
            yield fields, body[: int(fields["Content-Length"])]
            gz, data = zlib.decompressobj(31), b""


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, revisits resolved: their payload's
    length comes from the response they refer to."""
    spark = manifest.sparkSession

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .files import open_input

        for batch in batches:
            for path in batch.path:
                rows = []
                with open_input(path) as stream:
                    for h, block in records(stream):
                        name = h["WARC-Record-ID"][len("<urn:page:") : -1]
                        ref = h.get("WARC-Refers-To")
                        told = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = block.partition(b"\r\n\r\n")[2]
                        if ref is None and hashlib.sha1(payload).hexdigest() != told:
                            raise ValueError(f"payload of {name} in {path} does not match its digest")
                        rows.append((None if name == "none" else int(name), None if ref else len(payload), told, h["WARC-Type"], int(ref[len("<urn:page:") : -1]) if ref else None))
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    got = manifest.repartitionByRange(C.parts(spark), "shard").mapInPandas(load, schema)
    own = got.where("record_type = 'response'")
    # A page may refer to a response once only, and a response is asked for by its digest too.
    to = own.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    back = got.where("record_type = 'revisit'").join(to, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("_bytes"))
    return own.unionByName(back.select(own.columns))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return x.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def op8(spark, sf_dir: str) -> DataFrame:
    return read(write(C.table(spark, sf_dir, "pages"), C.fresh_dir(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND p.payload_bytes >= 1000
"""
