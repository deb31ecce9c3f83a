"""WARC archives with a dictionary: a writer and a reader.

A Zstandard dictionary is built from a bounded draw of the records' payloads. An archive (.warc.zst) begins with a skippable
frame (magic 0x184D2A5D) that holds the dictionary; each record then is a frame of its own, compressed with it, so any record
can be read by its offset. Payloads that occur again are written once: of the records with equal payloads that with the
largest page_id is a response, the others are revisits that refer to it.

Each task of the writer writes its archives into one folder that all executors share, under a temporary name which it renames
when the archive is complete; a task that runs again replaces its archive by an equal one. Archives are rolled at
`archive_bytes`. What was written is kept as a manifest table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, shared_dir

MAGIC = 0x184D2A5D
MANIFEST = "archive string, records long, bytes long"
READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    """The file system of a URI and the path in it: local, HDFS, S3 and what else Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def train_dictionary(pages: DataFrame, size: int = 64 << 10, max_records: int = 1000, max_bytes: int = 16 << 10) -> bytes:
    """A dictionary of at most size bytes, from the first max_bytes of about max_records payloads drawn by a hash of their id; a raw-content one if there is too little to train on."""
    n = pages.count()
    share = int((1 << 30) * min(1.0, max_records / max(n, 1)))
    drawn = pages.filter(F.pmod(F.xxhash64("page_id", F.lit("dictionary")), F.lit(1 << 30)) < share).limit(2 * max_records)
    samples = [bytes(r[0]) for r in drawn.select(F.encode(F.substring(F.coalesce("html", F.lit("")), 1, max_bytes), "UTF-8")).collect()]
    samples = sorted(s for s in samples if len(s) >= 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n"


HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def warcinfo(name: str, date: str) -> bytes:
    return _record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def build_record(name: str, page_id: str | None, url: str | None, payload: bytes | None, size: int, sha1: str, date: str, original: tuple[str, str | None, str | None] | None = None) -> bytes:
    """A response, or, with an original (its record's name, page id and url), a revisit, whose block is empty. Digest and size are of the whole payload either way."""
    fields = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": record_id(name),
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "X-Page-ID": page_id or "",
        "X-Payload-Length": str(size),
    }
    if original is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original[0]), "WARC-Refers-To-Target-URI": _uri(original[2]), "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": original[1] or ""}
    fields["Content-Type"] = "application/http; msgtype=response"
    return _record(fields, b"" if original is not None else HTTP_HEAD.format(size).encode() + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, and of a response the payload, else the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.partition(": ")[::2] for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block


def _writer(folder: str, dictionary: bytes, archive_bytes: int, level: int, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        number, out, size, records, name = 0, None, 0, 0, ""

        def close() -> pd.DataFrame:
            nonlocal out, number
            out.close()
            fs.move(f"{root}/{temporary}", f"{root}/{name}")
            out, number = None, number + 1
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        def add(record: bytes) -> None:
            nonlocal size
            frame = packer.compress(record)
            out.write(frame)
            size += len(frame)

        text = lambda x: x if isinstance(x, str) else None
        for pdf in batches:
            for page_id, url, html, key, length, kind, of_id, of_url in pdf.itertuples(index=False):
                if out is None:
                    # an attempt's own name: a repeated or speculative one can't replace what the manifest of another names
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}-{number:04d}.warc.zst"
                    temporary = f"_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                    out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                    size, records = 8 + len(dictionary), 0
                    add(warcinfo(f"{folder} {name}", date))
                page_id, url, of_id, of_url = text(page_id), text(url), text(of_id), text(of_url)
                sha1 = base64.b32encode(bytes.fromhex(key)).decode()
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                original = (f"{sha1} {of_id} {of_url}", of_id, of_url) if kind == "revisit" else None
                own = f"{sha1} {page_id} {url}" if kind == "response" else f"{folder} {name} {records}"
                add(build_record(own, page_id, url, payload, int(length), sha1, date, original))
                records += 1
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, archive_bytes: int = 64 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into folder; returns the manifest: archive, records, bytes.

    Of rows with equal payloads that with the largest page_id is the response, of equal ids that with the largest url; of rows that
    are equal in these too, one. A null page_id comes last; a revisit of a payload that has no other refers to null.
    Payloads of fewer than least_bytes bytes are always responses. A null html is an empty payload. Other columns are ignored.

    Rows with equal payloads are reduced to one, in each partition first, so a payload that many rows have is shuffled once a
    partition at most; what is left of the others is their id, url, digest and size.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("key"), F.octet_length(payload).alias("length"))
    none, large = F.lit(None).cast("string"), F.col("length") >= least_bytes
    page_id = F.col("page_id").cast("string").alias("page_id")  # pandas would make doubles of longs with nulls
    first = rows.filter(large).groupBy("key", "length").agg(F.max(F.struct("page_id", "url", "html")).alias("r")).select("key", "length", "r.*")
    responses = first.select(page_id, "url", "html", "key", "length", F.lit("response").alias("kind"), none.alias("of_id"), none.alias("of_url"))
    small = rows.filter(~large).select(page_id, "url", "html", "key", "length", F.lit("small").alias("kind"), none.alias("of_id"), none.alias("of_url"))
    light = rows.filter(large).groupBy("key", "page_id", "url", "length").agg(F.count(F.lit(1)).alias("times"))
    to = light.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("of")).select("key", F.col("of.page_id").alias("of_id"), F.col("of.url").alias("of_url"))
    itself = F.col("page_id").eqNullSafe(F.col("of_id")) & F.col("url").eqNullSafe(F.col("of_url"))
    again = light.join(to, "key").withColumn("times", F.col("times") - itself.cast("int")).filter("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    revisits = again.select(page_id, "url", none.alias("html"), "key", "length", F.lit("revisit").alias("kind"), F.col("of_id").cast("string").alias("of_id"), "of_url")
    written = responses.union(small).union(revisits)
    return materialize(written.mapInPandas(_writer(folder, train_dictionary(pages), archive_bytes, level, date), MANIFEST), "warc-manifest")


def read_records(fs, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of an archive, one at a time."""
    with fs.open_input_stream(path, compression=None) as f:
        magic, length = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(length)))
        offset, held = 8 + length, b""
        while True:
            frame = unpacker.decompressobj()
            parts, fed = [], 0
            while not frame.eof:
                if not held:
                    held = f.read(1 << 20)
                    if not held:
                        if fed:
                            raise ValueError(f"{path} ends within a record")
                        return
                parts.append(frame.decompress(held))
                fed += len(held) - len(frame.unused_data)
                held = frame.unused_data
            yield offset, b"".join(parts)
            offset += fed


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records of all archives in the manifest but warcinfo: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, offset. Digests of responses are computed from the payload read."""
    columns = [c.split()[0] for c in READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                rows = []
                fs, path = _open(archive)
                for offset, data in read_records(fs, path):
                    fields, payload = parse_record(data)
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                    sha1 = digest(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((fields["X-Page-ID"] or None, fields["WARC-Target-URI"], size, sha1, kind, fields.get("X-Refers-To-Page-ID") or None, archive, offset))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    parts = max(1, manifest.count())
    found = manifest.select("archive").repartition(parts, "archive").mapInPandas(run, READ)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
