"""WARC archives written by many tasks, the same bytes in every run, and read back.

Records are dealt to shards by ranges of the id and sorted inside them. A shard's files are rolled when their
compressed size passes a limit. Headers, record ids and digests are made anew from the payload. A task writes under a
temporary name of its attempt; the manifest of the attempts that counted decides which files are moved to their final
names, and it is written last. Attempts of lost or repeated tasks are never named by it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import sys
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_BYTES = 16 << 20
#: payload bytes of a shard: a share of all, within bounds
SHARES, LEAST_BYTES, MOST_BYTES = 200, 128 << 10, 1 << 30
BINS = 1024
#: parts of a range that is divided again, for each part that it needs
FINER = 16
DATE = "2000-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base 32: every five hexadecimal digits are four letters."""
    letters = []
    for group in range(8):
        number = F.conv(F.substring(F.sha1(payload), 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def record(url: str | None, id: int | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member of its own; a revisit has no body."""
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{id}:{url}:{digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if id is None else id}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # its gzip header holds no time and no name
    return packer.compress(data) + packer.flush()


def clean(url: str | None) -> str:
    """A URL on one line."""
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes):
    """The records of an archive: headers and payload, which is empty for revisits."""
    while data:
        unpacker = zlib.decompressobj(31)
        raw = unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        yield headers, block.partition(b"\r\n\r\n")[2]


def edges(pages: DataFrame, id: str, bytes_: str, target: int) -> list[int]:
    """Lower edges of id ranges that hold about `target` bytes each; fixed by the rows alone.

    Ids are counted in BINS equal ranges; a range that holds too much is divided again, into FINER times as many as it needs.
    One id is never divided. The driver gets a few counts per range that comes out.
    """
    low, high = pages.agg(F.min(id), F.max(id)).first()
    if low is None:
        return []
    found: dict[int, int] = {}
    step = (high - low) // BINS + 1
    steps = {low: step}
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(bytes_).alias("size"), F.lit(low).cast("long").alias("bin"), F.lit(step).cast("long").alias("step"))
    while steps:
        # all ranges of a round are counted in one pass
        at = rows.withColumn("bin", F.expr("bin + (id - bin) div step * step"))
        again = {}
        for key, step, size in at.groupBy("bin", "step").agg(F.sum("size")).collect():
            if size > target and step > 1:
                again[key] = (step - 1) // min(BINS, FINER * -(-size // target)) + 1
            else:
                found[key] = size
        steps = again
        if steps:
            divided = pages.sparkSession.createDataFrame(list(steps.items()), "bin long, step long")
            rows = at.drop("step").join(F.broadcast(divided), "bin")
    out, held = [], target
    for key in sorted(found):
        if held + found[key] > target:
            out.append(key)
            held = 0
        held += found[key]
    return out


def write(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
    file_bytes: int = FILE_BYTES, shard_bytes: int | None = None, date: str = DATE,
) -> DataFrame:
    """Write the pages to folder/*.warc.gz and return the manifest: file, records, bytes, sha1.

    The payload is the text in UTF-8, empty for null. Of records with equal payloads of at least `least` bytes the one
    with the smallest id is a response, the others are revisits of it; smaller ones are all responses. Of rows that
    repeat id and payload the first is the response. Rows with a null id go first and are never referred to unless all
    copies have a null id, then all are responses. Other columns are left out. `folder` is new; the path may be any
    that pyarrow can open. An empty table gives a manifest without files.
    """
    kind = pages.schema[id].dataType.simpleString()
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"), raw.alias("_raw")).withColumn("_digest", F.sha1("_raw"))
    slim = cut(rows.select("_id", "_digest", F.octet_length("_raw").cast("long").alias("_size")))
    if shard_bytes is None:
        total = slim.agg(F.sum("_size")).first()[0] or 0
        shard_bytes = min(max(LEAST_BYTES, total // SHARES), MOST_BYTES)
    low = edges(slim.filter("_id is not null"), "_id", "_size", shard_bytes)
    first = cut(slim.filter(F.col("_size") >= least).groupBy("_digest").agg(F.min("_id").alias("_first")))
    # decisions travel to the shard beside the payloads; copies of one id need one decision
    decided = slim.join(first, "_digest").filter("_id is null or _id >= _first").select("_id", "_digest", "_first").distinct()
    place = Bucketizer(splits=[-math.inf, *map(float, low[1:]), math.inf], inputCol="_number", outputCol="_shard")
    empty = lambda t: F.lit(None).cast(t)
    both = rows.withColumns({"_first": empty(kind), "_kind": F.lit(1)}).unionByName(
        decided.withColumns({"_url": empty("string"), "_raw": empty("binary"), "_kind": F.lit(0)})
    ).withColumn("_number", F.coalesce(F.col("_id").cast("double"), F.lit(-math.inf)))
    both = (place.transform(both) if len(low) > 1 else both.withColumn("_shard", F.lit(0))).withColumn("_shard", F.col("_shard").cast("int"))
    dealt = both.drop("_number").repartitionByRange(max(1, len(low)), "_shard").sortWithinPartitions("_shard", F.col("_id").asc_nulls_first(), "_digest", "_kind", "_url")

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        attempt = f"{path}/_temporary/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        out, done = None, []
        key = known = None
        again = False

        def close():
            nonlocal out
            if out:
                out["stream"].close()
                done.append({"file": out["name"], "temporary": f"{attempt}/{out['name']}", "records": out["n"], "bytes": out["bytes"], "sha1": out["sha1"].hexdigest()})
                out = None

        last_shard, number = None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("_shard", "_id", "_digest", "_kind", "_url", "_raw", "_first")]
            for i in range(len(batch)):
                place, page, digest, sort, link, body, origin = (c[i].as_py() for c in columns)
                if (place, page, digest) != key:
                    key, known, again = (place, page, digest), None, False
                if sort == 0:
                    known = origin
                    continue
                refers = known if known is not None and (page != known or again) else None
                again = True
                if place != last_shard:
                    close()
                    last_shard, number = place, 0
                elif out and out["bytes"] >= file_bytes:
                    close()
                    number += 1
                if out is None:
                    name = f"part-{place:06d}-{number:06d}.warc.gz"
                    out = {"name": name, "stream": store.open_output_stream(f"{attempt}/{name}", compression=None), "n": 0, "bytes": 0, "sha1": hashlib.sha1()}
                data = record(link, page, body, base64.b32encode(bytes.fromhex(digest)).decode(), refers, date)
                out["stream"].write(data)
                out["sha1"].update(data)
                out["n"] += 1
                out["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["file", "temporary", "records", "bytes", "sha1"]), schema=pa.schema(
            [("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]
        ), preserve_index=False)

    # written once: the rows name the attempts that counted
    written = cut(dealt.mapInArrow(run, "file string, temporary string, records bigint, bytes bigint, sha1 string"))
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    files = sorted((r.asDict() for r in written.collect()), key=lambda r: r["file"])  # one row per file
    for file in files:
        store.move(file.pop("temporary"), f"{path}/{file['file']}")
    if files:
        store.delete_dir(f"{path}/_temporary")
    with store.open_output_stream(f"{path}/MANIFEST.tmp", compression=None) as out:
        out.write("".join(json.dumps(f, sort_keys=True) + "\n" for f in files).encode())
    store.move(f"{path}/MANIFEST.tmp", f"{path}/MANIFEST.json")
    return written.drop("temporary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload (null for revisits). A payload that does not fit its digest, or a file that differs from the
    manifest or is missing, is an error. payload_bytes and payload_digest are those of the full payload.
    """
    named = spark.read.schema("file string, records bigint, bytes bigint, sha1 string").json(f"{folder}/MANIFEST.json")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    found = found.withColumn("file", F.element_at(F.split("path", "/"), -1))
    if not named.join(found.select("file"), "file", "left_anti").isEmpty():  # names only, no content is read
        raise ValueError("an archive of the manifest is missing")
    # Spark broadcasts a manifest under the session's threshold by itself
    files = found.join(named, "file")

    def run(batches):
        for batch in batches:
            for content, sha1, records in zip(batch.column("content"), batch.column("sha1"), batch.column("records")):
                data, rows, left = content.as_py(), [], records.as_py()
                if hashlib.sha1(data).hexdigest() != sha1.as_py():
                    raise ValueError("an archive differs from its manifest")
                for headers, payload in parse(data):
                    left -= 1
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    fresh = headers["WARC-Type"] == "response"
                    if fresh and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID", "")
                    rows.append((
                        int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(headers["X-Payload-Length"]), digest,
                        int(refers) if refers else None, payload.decode("utf-8", "replace") if fresh else None,
                    ))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if left:
                    raise ValueError("an archive holds more or fewer records than its manifest says")
                yield _batch(rows)

    return files.select("content", "sha1", "records").mapInArrow(run, READ)


READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = [part.split()[0] for part in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
