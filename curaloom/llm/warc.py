"""WARC archives, index first.

Writing yields an index row per record: file, offset, length, URL and digest.
Reading starts from selected rows of an index: sorted by file and offset, ranges
that lie close together are joined into one read, and each record is unpacked
from its own bytes.  Records are gzip members of their own, as readers of WARC
expect.  Files lie in the shared folder and are opened through
``pyarrow.fs``, which takes local paths, HDFS and object stores alike.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, new_path, small_batches, store

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes between two wanted ranges that are read along rather than skipped, and most bytes of one read.
GAP, MOST = 1 << 16, 1 << 23
#: Tasks that read at most; with more stretches than that, a task has several.
MOST_TASKS = 20_000


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One record before compression.  A revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{quote(page, safe='-')}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='-')}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters that stay as they are in a URL's header line.
SAFE = "%/:?#[]@!$&'()*+,;=-._~"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of one unpacked record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    named = fields(head)
    block = rest[: int(named["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, fields(http), payload


def decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, at_least: int) -> DataFrame:
    """``id, url, payload`` (null for revisits), ``size, refers_to, revisit, sha1``.

    Digests alone decide: ids and digests are grouped, and the verdicts of groups
    with more than one row are brought back to the rows by digest.  Revisits take
    no payload into the exchange where verdicts are few enough to be sent; else
    the copies of a very common payload are a key that adaptive execution splits.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("size"), F.unhex(F.sha2("payload", 256)).alias("sha"))
    groups = rows.groupBy("sha").agg(F.max("id").alias("chosen"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= at_least))
    groups = store(groups.select("sha", "chosen"), "warc-groups")
    few = groups.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    both = rows.join(F.broadcast(groups) if few else groups, "sha", "left")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("chosen")) & F.col("chosen").isNotNull(), F.lit(False))
    both = both.withColumn("revisit", revisit)
    return both.select("id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", F.when(F.col("revisit"), F.col("chosen")).alias("refers_to"), "revisit", F.unhex(F.sha1("payload")).alias("sha1"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at_least: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write a record per row and return the index, itself stored in the shared folder.

    Of records with equal payloads of at least ``at_least`` bytes, those with the
    largest id are responses and the others revisits that refer to it; smaller
    ones are all responses.

    Defined cases: a null payload is the empty one; a null URL leaves the header
    line out; a row with a null id is a revisit where another of its group has an
    id, else a response; repeated rows with the largest id are all responses; an
    empty table gives an empty index; other columns aren't read.  A task that runs
    again writes a file of a new name, and the index names only the files of the
    attempts that counted.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    small_batches(spark)
    rows = decided(pages, id_col, url_col, payload_col, at_least)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", F.col("id").cast("string").alias("name"), F.col("url").cast("string").alias("url"), "payload", "size", F.col("refers_to").cast("string").alias("to"), "revisit", "sha1")

    def run(batches):
        task, store_of, out, nth, offset = TaskContext.get(), None, None, 0, 0
        try:
            for batch in batches:
                index = []
                for name, url, payload, size, to, revisit, sha1 in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    if store_of is None:
                        store_of, root = FileSystem.from_uri(folder)
                        store_of.create_dir(root, recursive=True)
                    if out is None or offset >= roll_bytes:
                        if out is not None:
                            out.close()
                        file = f"records-{task.partitionId():06d}-{task.taskAttemptId()}-{nth:03d}.warc.gz"
                        out, nth, offset = store_of.open_output_stream(f"{root}/{file}", compression=None), nth + 1, 0
                    digest = base64.b32encode(sha1).decode()
                    data = member(record(name, url, payload, size, digest, to, revisit, date), level)
                    out.write(data)
                    index.append((f"{folder}/{file}", offset, len(data), url, digest, "revisit" if revisit else "response"))
                    offset += len(data)
                columns = [pa.array([row[k] for row in index], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "file", "offset", "length", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return store(rows.mapInArrow(run, f"id {kind}, file string, offset bigint, length bigint, url string, digest string, record_type string"), "warc-index")


def read_records(index: DataFrame, id_type: str = "bigint", with_payload: bool = True, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records that the rows of ``index`` name, checked against their digests.

    Returns ``id, payload_bytes, payload_digest, record_type, refers_to`` and, if
    asked for, ``payload`` (null for revisits).  Rows are dealt out by stretches of
    ``most`` bytes of a file.  Their number follows from the bytes to read: index
    rows are tiny, so their own size says nothing about the work, and adaptive
    execution would put them all into one task.

    Defined cases: a row named twice is read twice; an empty index gives an empty
    result; a record without an id has a null id; a payload that doesn't match its
    digest, and a record that doesn't end where its length says, raise an error;
    other columns of the index aren't read.
    """
    small_batches(index.sparkSession)
    stretch = F.floor(F.col("offset") / most)
    parts = min(index.agg(F.count_distinct("file", stretch)).first()[0], MOST_TASKS)
    spots = index.select("file", "offset", "length", stretch.alias("stretch")).repartition(max(parts, 1), "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")

    def run(batches):
        opened: dict = {"name": None}

        def fetch(rows):
            name, first = rows[0][:2]
            if opened["name"] != name:
                if opened["name"]:
                    opened["file"].close()
                store_of, path = FileSystem.from_uri(name)
                opened.update(name=name, file=store_of.open_input_file(path))
            block = opened["file"].read_at(max(o + n for _, o, n in rows) - first, first)
            for _, offset, length in rows:
                yield unpacked(zlib.decompress(block[offset - first : offset - first + length], 31))

        def unpacked(data):
            head, http, payload = parse(data)
            kind, size, digest = head["WARC-Type"], int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload) != size or digest32(payload) != digest):
                raise ValueError(f"the payload of {head.get('WARC-Record-ID')} doesn't match its digest")
            return own_id(head.get("WARC-Record-ID")), size, digest, kind, own_id(head.get("WARC-Refers-To")), payload if kind == "response" else None

        def arrow(rows):
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())[: 5 + with_payload]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload])

        held = []
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or row[1] > held[-1][1] + held[-1][2] + gap or row[1] + row[2] - held[0][1] > most):
                    made += fetch(held)
                    held = []
                held.append(row)
            if made:
                yield arrow(made)
        if held:
            yield arrow(list(fetch(held)))
        if opened["name"]:
            opened["file"].close()

    found = spots.mapInArrow(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def own_id(urn: str | None) -> str | None:
    from urllib.parse import unquote

    return None if urn is None else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))
