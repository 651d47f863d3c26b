"""WARC archives, written with an index first and read back by coalesced ranges.

Writing: each task appends gzip-member records to files of its own in the
shared folder and returns an index row per record (file, offset, length, URL,
digest ...).  A task that is run again writes files with new names; only the
rows of the attempt that Spark commits are in the index, so a lost executor
leaves no wrong entry.  Equal payloads of at least ``min_revisit`` bytes are
stored once: the row with the largest id is the response, the others revisit
it (rows that share the largest id are all responses).

Reading: the selected index rows are sorted by (file, offset); neighbours less
than ``gap`` bytes apart form one range of about ``range_bytes``, which is
read at once and cut into records.

Defined cases: a null payload is empty, a null URL leaves its header out, line
breaks in a URL are percent-encoded, a null id is written as ``null`` and is
never referred to unless all copies have null ids (then each is a response).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, join_path, open_store, shared_folder

FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
HEAVY = 1000
READ_BYTES, LEAST_BYTES = 64 << 20, 1 << 20  # archive bytes of a reading task
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()), ("url", pa.string()),
                   ("payload_digest", pa.string()), ("record_type", pa.string())])
INDEX_DDL = "file string, offset long, length long, id long, url string, payload_digest string, record_type string"
RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(rid: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if rid is None else rid}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> dict:
    """One gzip member: its headers, and the payload of a response; checks its length and digest."""
    data = zlib.decompress(raw, 31)
    cut_at = data.index(b"\r\n\r\n")
    lines = data[:cut_at].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    payload = data[cut_at + 4:cut_at + 4 + int(head["Content-Length"])]
    declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if lines[0] != "WARC/1.1" or len(data) != cut_at + 8 + len(payload):
        raise ValueError("not a record")
    if kind == "response":
        size, declared_again = len(payload), digest(payload)
        if declared_again != declared:
            raise ValueError(f"payload digest {declared_again}, header {declared}")
    else:
        size = int(head["X-Payload-Length"])

    def number(x: str | None) -> int | None:
        x = x and x[len("<urn:page:"):-1]
        return None if x in (None, "null") else int(x)

    return {"id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": declared,
            "record_type": kind, "refers_to": number(head.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _with_keeper(df: DataFrame, id_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """Rows with ``sha`` and, where the payload has copies, ``keeper``: the largest id.

    Payloads with many copies (at most ``HEAVY`` digests can each hold a
    thousandth of the rows, rounded up) meet the rows by a broadcast of that
    proven size, all others by an ordinary join.
    """
    rows = df.withColumn("sha", F.sha1(F.col(payload_col).cast("binary")))
    big = F.octet_length(payload_col) >= min_revisit
    counts = (df.filter(big).select(F.col(id_col).alias("i"), F.sha1(F.col(payload_col).cast("binary")).alias("sha"))
              .groupBy("sha").agg(F.max("i").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copies = cut(counts, "payload-copies")
    limit = max(2, -(-df.select(F.lit(1)).count() // HEAVY))
    heavy = copies.filter(F.col("n") >= limit)  # n * HEAVY >= rows
    heavy_rows = heavy.select(F.col("sha").alias("sha_h"), F.col("keeper").alias("keeper_h"))
    rows = rows.join(F.broadcast(heavy_rows), rows["sha"] == heavy_rows["sha_h"], "left")
    light = copies.filter(F.col("n") < limit).select(F.col("sha").alias("sha_l"), F.col("keeper").alias("keeper_l"))
    rows = rows.withColumn("probe", F.when(F.col("sha_h").isNull() & big, F.col("sha")).otherwise(F.concat(F.lit("~"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    rows = rows.join(light, F.col("probe") == F.col("sha_l"), "left")
    return rows.withColumn("keeper", F.coalesce("keeper_h", "keeper_l")).drop("sha_h", "keeper_h", "sha_l", "keeper_l", "probe")


def write(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str | None = None, min_revisit: int = 0,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row as a record; returns the index."""
    folder = folder or shared_folder(df.sparkSession, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = _with_keeper(rows, "id", "payload", min_revisit).select("id", "url", F.col("payload").cast("binary"), "keeper")

    def put(batches):
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        task, out, name, at = TaskContext.get(), None, None, 0
        try:
            for batch in batches:
                made = []
                for rid, url, payload, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(join_path(root, name), compression=None)
                    d = digest(payload)
                    refers = None if keeper is None or rid == keeper else keeper
                    raw = make_record(rid, url, payload, d, refers)
                    out.write(raw)
                    made.append({"file": name, "offset": at, "length": len(raw), "id": rid, "url": url, "payload_digest": d,
                                 "record_type": "response" if refers is None else "revisit"})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(made, schema=INDEX)
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInArrow(put, INDEX_DDL), "warc-index").withColumn("folder", F.lit(folder))


def ranges(selected: DataFrame, gap: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Coalesced byte ranges of the selected index rows: folder, file, lo, hi, records [(offset, length)]."""
    w = Window.partitionBy("folder", "file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = (F.col("offset") - F.lag(end).over(w) > gap) | (F.floor(F.col("offset") / range_bytes) != F.floor(F.lag("offset").over(w) / range_bytes))
    x = selected.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("range", F.sum("new").over(w))
    return (x.groupBy("folder", "file", "range")
            .agg(F.min("offset").alias("lo"), F.max(end).alias("hi"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")))


def read(selected: DataFrame, payloads: bool = True, gap: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the selected index rows, each checked against its digest."""
    def get(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = open_store(row["folder"])
                with fs.open_input_file(join_path(root, row["file"])) as f:
                    f.seek(row["lo"])
                    data = f.read(row["hi"] - row["lo"])
                got = []
                for r in row["records"]:
                    at = r["offset"] - row["lo"]
                    x = parse_record(data[at:at + r["length"]])
                    got.append(x if payloads else x | {"payload": None})
                yield pa.RecordBatch.from_pylist(got, schema=RECORD)

    # tasks by the archives' bytes, not by the index's
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // READ_BYTES), min(selected.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), 1)
    wanted = ranges(selected, gap, range_bytes).repartition(int(tasks), "folder", "file", "range")
    return wanted.select("folder", "file", "lo", "hi", "records").mapInArrow(get, RECORD_DDL)
