"""A deterministic sharded WARC writer and its reader.

Writing: a histogram of page ids (4,096 buckets at most) cuts the id range into shards of about equal payload
bytes; a bucket larger than a shard gets a histogram of its own, of 4,096 cells, and is cut between cells, so shards
sort as their ids do. Only a cell that is larger than a shard by itself, a 16-millionth of the id range, is dealt by a hash of
id and digest, and repeated rows of one id and payload that are more than a shard in turn. Records go to their
shard in one shuffle and are sorted there by id. A task writes each shard as files of one gzip member a record, rolled by compressed size,
below a temporary name of its own attempt; the manifest of the attempts that Spark accepted is written as Parquet,
and only the files in it are renamed to their final names. Whatever lost or repeated attempts left goes away with
the temporary folder. Headers and digests are regenerated from the payload; dates are fixed, record ids derive
from page id and digest, so a rerun writes the same bytes.

Reading follows the manifest: its files, and no others that may lie there, are read in windows of a bounded size, and their
SHA-256, number of records, lengths and digests are compared.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page id is a response,
the others are revisits without payload that refer to it; smaller payloads are responses all.

Edge cases: a null html is an empty payload; a null id is written empty, sorts first and never has a response to
itself if another id is there; repeated rows with the largest id are responses each; a null url is written empty,
and line breaks in it are escaped; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.runtime import fresh_path, has_rows, materialize, remove_path, table

BUCKETS = 4096
#: A shard holds this part of all bytes, within bounds: enough shards for many tasks, none too large for one.
SHARDS, LEAST_SHARD_BYTES, MOST_SHARD_BYTES = 256, 256 << 10, 512 << 20
OVERHEAD = 512  # of a record's headers, about
ROLL_BYTES = 16 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard string, name string, temporary string, records long, bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}').urn}>"


def _escaped(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _escaped(url)), ("Content-Type", "application/http; msgtype=response")]
    headers += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _member(headers, block, level)


WINDOW = 64 << 10


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of the gzip members of a file that comes in pieces; what is held is one member and one piece."""
    open_, raw, at = zlib.decompressobj(31), [], 0
    for chunk in chunks:
        while chunk:
            raw.append(open_.decompress(chunk))
            if not open_.eof:
                at += len(chunk)
                break
            yield b"".join(raw)
            at += len(chunk) - len(open_.unused_data)
            chunk, open_, raw = open_.unused_data, zlib.decompressobj(31), []
    if raw:
        raise ValueError(f"the gzip member before {at} is cut off")


def read_records(source: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file, whole or in pieces; raises ValueError where a digest or a length is wrong."""
    for number, raw in enumerate(_members([source] if isinstance(source, bytes) else source)):
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
            raise ValueError(f"record {number} is malformed")
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"record {number} has another block digest")
        yield headers, block


def _cuts(rows: DataFrame, shard_bytes: int | None):
    """Functions that add the column shard to a table with page_id and sha1, for payloads and for what is known of them,
    from ``rows`` (page_id, sha1, bytes); the same for the same rows in any order. Shards sort as their page ids do."""
    low, high, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("bytes") + OVERHEAD)).first()
    low, high = low or 0, high or 0
    aim = shard_bytes or min(MOST_SHARD_BYTES, max(LEAST_SHARD_BYTES, (total or 0) // SHARDS))
    width = max(1, -(-(high - low + 1) // BUCKETS))
    fine = max(1, -(-width // BUCKETS))
    kind = "long" if high - low < 1 << 62 else "decimal(38,0)"
    offset = f"(cast(page_id as {kind}) - cast({low} as {kind}))"
    bucket = F.expr(f"coalesce(cast({offset} div cast({width} as {kind}) as int), -1)")
    cell = F.expr(f"coalesce(cast(({offset} % cast({width} as {kind})) div cast({fine} as {kind}) as int), 0)")
    size = F.sum(F.col("bytes") + OVERHEAD).alias("size")
    sums = rows.groupBy(bucket.alias("bucket")).agg(size)  # at most BUCKETS + 1 rows
    before = F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.select("bucket", "size", F.floor(before / F.lit(aim)).cast("int").alias("first")), "warc-cuts")
    large = sums.filter(F.col("size") > 2 * aim).select("bucket")
    # At most BUCKETS rows are broadcast here, and BUCKETS cells of a bucket meet in a window.
    cells = rows.withColumn("bucket", bucket).join(F.broadcast(large), "bucket").groupBy("bucket", cell.alias("cell")).agg(size)
    inside = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("part", F.floor(F.coalesce(F.sum("size").over(inside), F.lit(0)) / F.lit(aim)).cast("int"))
    split = F.collect_list(F.when(F.col("size") > 2 * aim, F.struct("cell", F.ceil(F.col("size") / F.lit(aim)).cast("int").alias("parts"))))
    inner = cells.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("part", "cell"))).alias("cells"), split.alias("split"))
    # Where parts begin: 4 bytes for each shard, the only thing here that grows with the data.
    begins = F.expr("transform(filter(cells, (c, i) -> i = 0 OR c.part > cells[i - 1].part), c -> c.cell)")
    cut = materialize(sums.join(inner.select("bucket", begins.alias("begins"), "split"), "bucket", "left").select("bucket", "first", "begins", "split"), "warc-cuts")

    def place(df: DataFrame, known: bool) -> DataFrame:
        placed = df.withColumn("bucket", bucket).withColumn("cell", cell).join(cut, "bucket")
        parts = F.expr("try_element_at(transform(filter(split, s -> s.cell = cell), s -> s.parts), 1)")
        # Rows of one id and payload go to one part, unless they are too many: then to all parts in turn, and what is known of them to each.
        again = F.coalesce("repeats", F.lit(False))
        chosen = F.when(parts.isNull(), F.array(F.lit(0)))
        by_hash = F.pmod(F.xxhash64("page_id", "sha1"), parts).cast("int")
        in_turn = F.sequence(F.lit(0), parts - 1) if known else F.array(F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
        chosen = chosen.when(again, in_turn).otherwise(F.array(by_hash))
        place_ = F.expr("size(filter(begins, b -> b <= cell))")
        name = F.when(F.col("begins").isNull(), F.format_string("%08d", "first"))
        name = name.when(parts.isNull(), F.format_string("%08d-%04d-%06d", "first", F.col("bucket") + 1, place_))
        name = name.otherwise(F.format_string("%08d-%04d-%06d-%06d", "first", F.col("bucket") + 1, place_, F.col("turn")))
        return placed.withColumn("turn", F.explode(chosen)).withColumn("shard", name).drop("bucket", "cell", "first", "begins", "split", "turn", "repeats")

    return place, aim


def _marked(df: DataFrame, often: DataFrame) -> DataFrame:
    """``df`` with the column repeats: whether (page_id, sha1) is in ``often``."""
    found = often.select(F.col("page_id").alias("page_id_"), F.col("sha1").alias("sha1_"))
    joined = df.join(found, F.col("page_id").eqNullSafe(F.col("page_id_")) & (F.col("sha1") == F.col("sha1_")), "left")
    return joined.withColumn("repeats", F.col("sha1_").isNotNull()).drop("page_id_", "sha1_")


def write(pages: DataFrame, path: str, least_bytes: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``; returns the manifest, also kept there."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", F.sha1(html).alias("sha1"), "url", html.alias("html"))
    rows = materialize(full.select("page_id", "sha1", F.octet_length("html").alias("bytes")), "warc-rows")
    latest = materialize(rows.filter(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("latest")), "warc-latest")
    # What is known of a row goes to its shard by itself and meets the payload there, so payloads move once.
    known = rows.join(latest, "sha1", "left").select("page_id", "sha1", "bytes", F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to"))
    place, aim = _cuts(rows, shard_bytes)
    # Ids and payloads whose rows alone are larger than a shard: no more than there are shards.
    often = rows.groupBy("page_id", "sha1").agg(F.sum(F.col("bytes") + OVERHEAD).alias("size"), F.count("*").alias("n")).filter((F.col("size") > 2 * aim) & (F.col("n") > 1))
    often = materialize(often.select("page_id", "sha1"), "warc-often")
    mark = (lambda df: df.withColumn("repeats", F.lit(False))) if not has_rows(often) else lambda df: _marked(df, often)
    placed = materialize(place(mark(known.distinct()), True), "warc-placed")
    shards = placed.agg(F.countDistinct("shard")).first()[0]
    sent = place(mark(full), False).select("shard", "page_id", "sha1", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    both = sent.unionByName(placed.select("shard", "page_id", "sha1", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    temporary, final = f"{path}/_temporary", f"{path}/data"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, base = fs.FileSystem.from_uri(f"{temporary}/{uuid.uuid4().hex}")
        shard = stream = digest = name = refers = None
        number = records = size = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                done.append((shard, name, f"{base}/{name}", records, size, digest.hexdigest()))
                stream = None

        for batch in batches:
            for at, page_id, _, kind, refers_to, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != shard:
                    close()
                    shard, number = at, 0
                if not kind:
                    refers = refers_to
                    continue
                if stream is not None and size >= roll_bytes:
                    close()
                if stream is None:
                    name, records, size, digest = f"{shard}-{number:05d}.warc.gz", 0, 0, hashlib.sha256()
                    number += 1
                    disk.create_dir(base, recursive=True)
                    stream = disk.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, text.encode(), refers, level)
                stream.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "temporary", "records", "bytes", "sha256"), x, strict=True)) for x in done], schema=pa.schema([("shard", pa.string()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, base = fs.FileSystem.from_uri(final)
        for batch in batches:
            for name, old in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if disk.get_file_info(old).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    disk.create_dir(base, recursive=True)
                    disk.move(old, f"{base}/{name}")
            yield batch

    dealt = both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "page_id", "sha1", "kind", "url")
    dealt.select("shard", "page_id", "sha1", "kind", "refers_to", "url", "html").mapInArrow(put, MANIFEST).write.parquet(f"{path}/_attempts")
    moved = spark.read.schema(MANIFEST).parquet(f"{path}/_attempts").mapInArrow(commit, MANIFEST)
    moved.drop("temporary").write.parquet(f"{path}/manifest")
    remove_path(spark, temporary)
    remove_path(spark, f"{path}/_attempts")
    return spark.read.parquet(f"{path}/manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, file string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the files in the manifest that ``write`` left below ``path``, verified: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url, record_id, file, payload (null for revisits or without ``payloads``)."""
    data = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, base = fs.FileSystem.from_uri(data)
        for batch in batches:
            for name, records, size, sha in zip(*(batch.column(c).to_pylist() for c in ("name", "records", "bytes", "sha256")), strict=True):
                digest, got, taken = hashlib.sha256(), 0, 0

                def pieces(stream, digest=digest) -> Iterator[bytes]:
                    nonlocal taken
                    while piece := stream.read(WINDOW):
                        digest.update(piece)
                        taken += len(piece)
                        yield piece

                rows, held = [], 0
                with disk.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in read_records(pieces(stream)):
                        rows.append(_row(headers, block, name, payloads))
                        got, held = got + 1, held + (len(block) if payloads else 100)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if (got, taken, digest.hexdigest()) != (records, size, sha):
                    raise ValueError(f"{name} isn't the file that the manifest names")
                if rows:
                    yield _batch(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("name", "records", "bytes", "sha256")
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total // (128 << 20))))
    return manifest.repartition(tasks).mapInArrow(run, RECORDS)


def _row(headers: dict[str, str], block: bytes, name: str, payloads: bool) -> tuple:
    """A row of ``read`` from a record; raises ValueError if the payload isn't what its headers say."""
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    length, payload = int(headers["X-Payload-Length"]), None
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or base32_sha1(payload) != digest:
            raise ValueError(f"payload digest mismatch in {name}")
    own, other = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
    return (int(own) if own else None, length, digest, headers["WARC-Type"], int(other) if other else None, headers["WARC-Target-URI"], headers["WARC-Record-ID"], name, payload if payloads else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT html, max(page_id) AS latest FROM p GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + 5 * i, 5))::INT, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM (SELECT *, (SELECT string_agg(bin(('0x' || substr(sha1(html), i + 1, 1))::INT + 16)[2:], '' ORDER BY i) FROM range(40) t(i)) AS bits FROM p) p JOIN m USING (html)
"""
