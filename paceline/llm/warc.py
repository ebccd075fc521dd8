"""WARC archives by way of a chunked record table.

Archives are written and read by the tasks themselves.  On reading, payloads come out as rows
``(record, chunk number, bytes, running digest)``, so that no record is ever held whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import materialise, shared_dir, slices

CHUNK = 1 << 20
SALTS = 16
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:page")
_RECORD = "archive string, record_id string, record_type string, page_id long, target_uri string, refers_to_id string, declared_digest string, declared_bytes long"
_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("archive", "record_id", "record_type")] + [("page_id", pa.int64())]
    + [(n, pa.string()) for n in ("target_uri", "refers_to_id", "declared_digest")] + [("declared_bytes", pa.int64())]
    + [("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())]
)


def record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    """Of repeated rows each ``copy`` has a name of its own."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {copy}'.rstrip())}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach, by its URI (file://, hdfs://, s3://, ...)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def base32_of_hex(sha1):
    """Column: RFC 4648 base32 of a column of 40 hex digits, by its 32 groups of five bits."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(sha1, 10 * i + 1, 10), 16, 2), 40, "0") for i in range(4)))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(F.substring(letters, F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))


def _salt(column):
    """A few numbers dealt out by hash, so that the rows of one common payload go to as many tasks."""
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def record_types(rows: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, sha1, payload_bytes, copies, record_type, refers_to, shared)`` for each different (page_id, sha1) of ``rows`` (page_id, sha1, payload_bytes).

    Of equal payloads of ``least`` bytes or more, that with the largest page_id is the response and the others
    revisit it; a null page_id counts as the smallest.  ``copies`` counts repeated rows; ``shared`` tells the responses that others revisit.
    """
    own = rows.groupBy("page_id", "sha1", "payload_bytes").agg(F.count("*").alias("copies"))
    many = own.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    other = F.coalesce(F.col("page_id") < F.col("keeper"), F.col("page_id").isNull() & F.col("keeper").isNotNull())
    return own.withColumn("salt", _salt("page_id")).join(_salted(many), ["sha1", "salt"], "left").select(
        "page_id", "sha1", "payload_bytes", "copies", F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("keeper")).alias("refers_to"), (~other & F.col("n").isNotNull()).alias("shared"),
    )


def _header(kind: str, name: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: str | None = None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _views(column: pa.Array) -> list[memoryview]:
    """The cells of a binary column, without a copy."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[i:j] for i, j in zip(ends, ends[1:])]


def _write(chunks: DataFrame, where: str, kind: str, level: int) -> DataFrame:
    """Write records, given as their chunk rows one after the other, as gzip members into a file for each task; ``(archive, record_id, page_id, sha1, shared)`` of each."""
    schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("sha1", pa.string()), ("shared", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        files, root = file_system(where)
        files.create_dir(root, recursive=True)
        name = f"{root}/{kind}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        with files.open_output_stream(name, compression=None) as out:
            for part in slices(batches, "data", 4 * CHUNK):
                told: list[tuple] = []
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("chunk", "chunks", "page_id", "url", "sha1", "payload_digest", "payload_bytes", "copies", "refers_to_id", "shared")]
                for data, chunk, chunks, page, url, sha1, digest, size, copies, refers, shared in zip(_views(part.column(part.schema.get_field_index("data"))), *columns):
                    if chunk == 0:
                        n += 1
                        own, gz, running = record_id(page, digest, f"{task.partitionId()}-{n}" if copies > 1 else ""), zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                        out.write(gz.compress(_header(kind, own, page, url, digest, size if kind == "response" else 0, refers)))
                    running.update(data)
                    out.write(gz.compress(data))
                    if chunk == chunks - 1:
                        if kind == "response" and running.hexdigest() != sha1:
                            raise ValueError(f"chunks of {own} do not add up to its payload")
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        told.append((name, own, page, sha1, shared))
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), schema)], schema=schema)
        if not n:
            files.delete_file(name)

    return chunks.mapInArrow(run, "archive string, record_id string, page_id long, sha1 string, shared boolean")


def write_archives(pages: DataFrame, least: int = 0, level: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` (page_id, url, payload binary) as .warc.gz files; gives ``(archive, records, root)``.

    What is a response and what a revisit is settled on a narrow table of digests.  Payloads then go to the writers as rows
    of record and chunk number, which stream them into their files and hold a running digest against the
    payload's.  Revisits, which have no payload, follow in files of their own and name the record of their response.  A task that
    runs again writes a file of another name; only files of tasks that ended well are in the result.  Null payloads are empty, repeated rows and
    null ids have a record each, under different names, and an empty table gives no archive.
    """
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    where = shared_dir(pages.sparkSession, "warc")
    narrow = materialise(pages.select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-digests")
    types = materialise(record_types(narrow, least), "warc-types")
    key = types.withColumnsRenamed({"page_id": "t_id", "sha1": "t_sha1"})
    same = lambda df: F.col("page_id").eqNullSafe(F.col("t_id")) & (F.col("sha1") == F.col("t_sha1"))
    fields = ["page_id", "url", "sha1", base32_of_hex("sha1").alias("payload_digest"), "payload_bytes", "copies", "shared"]
    responses = pages.join(key.where("record_type = 'response'"), same(pages))
    chunks = F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1)).cast("int")
    responses = responses.select(*fields, F.lit(None).cast("string").alias("refers_to_id"), chunks.alias("chunks"), "payload", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    responses = responses.withColumn("data", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))).drop("payload")
    written = materialise(_write(responses, where, "response", level), "warc-responses")
    target = written.where("shared").groupBy(F.col("page_id").alias("refers_to"), F.col("sha1").alias("r_sha1")).agg(F.min("record_id").alias("refers_to_id"))
    # Only the one payload of a row differs in size here, so revisits need no more than their narrow rows.
    revisits = narrow.drop("payload_bytes").join(key.where("record_type = 'revisit'"), same(narrow)).withColumn("salt", _salt("page_id"))
    revisits = revisits.join(_salted(target).withColumnRenamed("salt", "r_salt"), (F.col("salt") == F.col("r_salt")) & (F.col("t_sha1") == F.col("r_sha1")) & key["refers_to"].eqNullSafe(target["refers_to"]))
    revisits = revisits.select(*fields, "refers_to_id", F.lit(1).alias("chunks"), F.lit(0).alias("chunk"), F.lit(b"").alias("data"))
    listed = written.unionByName(materialise(_write(revisits, where, "revisit", level), "warc-revisits"))
    return materialise(listed.groupBy("archive").agg(F.count("*").alias("records")), "warc-list").withColumn("root", F.lit(where))


def _inflate(stream, block: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a file of gzip members, in pieces of at most ``block`` bytes; other files come as they are."""
    gz, start = zlib.decompressobj(31), stream.read(2)
    packed = start == b"\x1f\x8b"
    data = start + stream.read(block)
    while data:
        if not packed:
            yield data
        else:
            while data:
                if piece := gz.decompress(data, block):
                    yield piece
                data = gz.unconsumed_tail
                if gz.eof:
                    data, gz = gz.unused_data, zlib.decompressobj(31)
        data = stream.read(block)
    if packed and (piece := gz.flush()):
        yield piece


def parse(pieces: Iterator[bytes], chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """(header, chunk number, data, bytes so far, hex SHA-1 so far, last) of each chunk of each record.

    Holds one header or one chunk at a time.  A record without a payload gives one empty chunk.
    """
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("the archive ends within a header")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        del held[: end + 4]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, number, done, digest = int(header["content-length"]), 0, 0, hashlib.sha1()
        while True:
            size = min(left, chunk)
            if not need(size):
                raise ValueError("the archive ends within a record")
            data = bytes(held[:size])
            del held[:size]
            digest.update(data)
            left, done = left - size, done + size
            yield header, number, data, done, digest.hexdigest(), not left
            number += 1
            if not left:
                break
        if not need(4) or held[:4] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        del held[:4]


def read_archives(listed: DataFrame, chunk: int = CHUNK, keep_data: bool = True) -> DataFrame:
    """The chunk table of archives listed as ``(archive, root)``: one row per record and chunk.

    Columns: archive, record_id, record_type, page_id, target_uri, refers_to_id, declared_digest, declared_bytes, chunk, data,
    bytes_so_far, sha1_so_far (hex, incremental), last.  ``keep_data=False`` leaves ``data`` null but still digests it.  A record without a
    payload has one empty chunk; records of equal content stay apart; no archives give no rows; a broken archive is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, _ = file_system(root)
                rows, size = [], 0
                with files.open_input_stream(archive, compression=None) as stream:
                    for h, number, data, done, sha1, last in parse(_inflate(stream), chunk):
                        bare = lambda k: h.get(k, "").strip("<>") or None
                        digest = h.get("warc-payload-digest", "")
                        page = h.get("x-page-id")
                        rows.append((archive, bare("warc-record-id"), h.get("warc-type"), int(page) if page else None, h.get("warc-target-uri"), bare("warc-refers-to"), digest.removeprefix("sha1:") or None, int(h["content-length"]), number, data if keep_data else None, done, sha1, last))
                        size += 300 + len(data) * keep_data
                        if size > 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    # A task for each archive, dealt out one after the other.
    files = listed.select("archive", "root").repartition(max(1, listed.count()))
    return files.mapInArrow(run, _RECORD + ", chunk long, data binary, bytes_so_far long, sha1_so_far string, last boolean")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write all rows of ``pages`` to archives, read these back, and tell what they hold.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: bytes and digest are those of the chunks read; a revisit
    takes them from the record that it refers to, after its own declared digest has been held against
    that.  Null payloads are empty; empty tables give no rows; other columns are left out; repeated rows and null
    ids have a record and a row each, like any others.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.col(html_col), "UTF-8").alias("payload"))
    chunks = read_archives(write_archives(rows, least), keep_data=False).where("last")
    read = materialise(chunks.select("record_id", "record_type", "page_id", "refers_to_id", "declared_digest", F.col("bytes_so_far").alias("payload_bytes"), base32_of_hex("sha1_so_far").alias("payload_digest")), "warc-read")
    responses = read.where("record_type = 'response'")
    checked = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "record_id")).cast("string"))
    kept = responses.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").withColumn("salt", _salt("page_id"))
    # The responses that others revisit, at a few places each, as one may have very many.
    target = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    target = target.join(revisits.select("refers_to_id").distinct(), "refers_to_id", "left_semi")
    again = revisits.join(_salted(target), ["refers_to_id", "salt"]).select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
    return kept.union(again)
