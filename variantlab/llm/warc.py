"""WARC archives with an index: records are written with offset, length, URL and digest, and read back by coalesced byte ranges.

Each task writes its records to one gzip member each, in a file of its own in the shared folder, and
returns their index rows; a task that runs again writes another file, and only rows of tasks that
succeeded are in the index, so a lost executor leaves no wrong entry.  The index is a Parquet table.
Readers sort the selected records by file and offset and fetch neighbours in one read.

Reading back hashes and measures the bytes of every response, and fails where they are not what the
headers say; a revisit gets digest and length of the response that it refers to, which must be there.

Of records with equal payloads the one with the smallest page_id is a response, and the others
revisit it.  Payloads below `least` bytes are all responses.  A null html is an empty payload, a null
url an empty target; repeated rows of a page_id are records of their own.  A null page_id comes after
all others: its record revisits one with a page_id, and is a response where there is none.  An empty
table gives no archive and an empty result; other columns, whatever their names, are not read.
Digests are counted before payloads are joined, so a payload that a third of all pages share is one
row by then.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.common import scratch, written

#: Smallest payload that may be a revisit; largest gap and size of one read, in bytes; records of a read task.
LEAST, GAP, READ = 0, 1 << 16, 8 << 20
#: A fixed date keeps archives the same from run to run.
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def digest_of(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _number(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name.startswith("<urn:page:") else None


def target_of(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def opening() -> bytes:
    """The record that describes an archive, its first one."""
    block = b"software: variantlab\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_name(None)}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with an HTTP head and the payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_of(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case, those of the HTTP head after `http-`) and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields |= {"http-" + k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return fields, payload


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives to `folder` and returns their index, itself a table there."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    shared = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("sha", "low")
    joined = rows.join(shared, "sha", "left").select("page_id", "url", "payload", F.when((F.col("page_id") > F.col("low")) | F.col("page_id").isNull(), F.col("low")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        file, offset, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(file, compression=None)
                    offset = out.write(_member(opening()))
                digest = digest_of(row["payload"])
                raw = _member(record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"]))
                out.write(raw)
                kind = "response" if row["refers_to"] is None else "revisit"
                found.append((row["page_id"], row["url"], digest, len(row["payload"]), kind, row["refers_to"], file, offset, len(raw)))
                offset += len(raw)
            if found:
                names = [x.split()[0] for x in INDEX.split(", ")]
                types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
        if out is not None:
            out.close()

    return written(joined.mapInArrow(run, INDEX), "warc-index")


def checked(raw: bytes, url: str) -> tuple[int | None, str, int | None, str, int, bytes]:
    """page_id, kind, refers_to, digest, length and payload of a record; a response's digest and length are those of its bytes."""
    fields, payload = parsed(raw)
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["http-content-length"])
    if kind == "response" and (digest_of(payload), len(payload)) != (digest, size) or fields["warc-target-uri"] != target_of(url):
        raise ValueError(f"the bytes of record {fields['warc-record-id']} are not those of its headers")
    return _number(fields["warc-record-id"]), kind, _number(fields.get("warc-refers-to")), digest, size, payload


def read(index: DataFrame, folder: str, gap: int = GAP, most: int = READ, payloads: bool = True) -> DataFrame:
    """The records of the index rows: page_id, url, record_type, refers_to, digest, payload_bytes and payload (null for revisits), from byte ranges.

    Neighbours in a file at most `gap` bytes apart are one read of at most about `most` bytes.
    """
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "url"))))
            for span in spans(rows, gap, most):
                with fs.open_input_file(span[0][0]) as f:
                    start = span[0][1]
                    data = f.read_at(span[-1][1] + span[-1][2] - start, start)
                found = []
                for _, offset, length, url in span:
                    page_id, kind, refers_to, digest, size, payload = checked(zlib.decompress(data[offset - start : offset - start + length], 31), url)
                    found.append((page_id, url, kind, refers_to, digest, size, payload if payloads and kind == "response" else None))
                columns = zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [x.split()[0] for x in schema.split(", ")])

    # ranges of files, so that one large file may be read by many tasks
    dealt = index.select("file", "offset", "length", "url").withColumn("part", F.floor(F.col("offset") / most))
    return dealt.repartition("file", "part").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records with digest and payload_bytes of the bytes that each stands for: a revisit's are those of the response it refers to."""
    own = records.where("record_type = 'response'")
    sure = own.groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("payload_bytes").alias("_bytes"))
    again = records.where("record_type = 'revisit'").join(sure, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    missing = F.raise_error(F.lit("a revisit refers to a response that isn't in the archives"))
    again = again.withColumn("payload_bytes", F.when(F.col("_id").isNull(), missing.cast("long")).otherwise(F.col("_bytes")))
    return own.union(again.select(*own.columns))


def spans(rows: list[tuple], gap: int, most: int) -> Iterator[list[tuple]]:
    """Runs of rows (file, offset, length, ...), sorted, that one read serves."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > gap or row[1] + row[2] - held[0][1] > most):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, of the bytes read back."""
    folder = scratch(pages.sparkSession, "warc")
    records = written(read(write(pages, folder, least), folder, payloads=False).drop("payload", "url"), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


#: The same in DuckDB; base32 from the hexadecimal digest, five bits at a time.
SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
m as (select h, min(page_id) as low from p group by h)
select page_id, octet_length(b)::bigint as payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((strpos('0123456789abcdef', substr(h, (5 * i // 4)::int + 1, 1)) - 1) * 16
      + greatest(strpos('0123456789abcdef', substr(h || '0', (5 * i // 4)::int + 2, 1)) - 1, 0)) // (2 ** (3 - 5 * i % 4))::int % 32)::int + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = low then 'response' else 'revisit' end as record_type,
  case when page_id = low then null else low end as refers_to
from p join m using (h)
"""
