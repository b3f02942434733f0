"""WARC records and a Merkle fixity audit of replicas.

Records are hashed; their digests, in order of offset, are hashed by ranges of ``SPAN`` bytes of a file
into leaves, and ``FANOUT`` neighbouring nodes at a time into the next level up to one root a file.
A replica's digests and nodes are stored once (``store``) and opened for every audit. An audit compares the
roots of two replicas and descends into differing branches only, down to the records that are altered,
missing or extra.

Only sizes and digests are placed and moved, never records. Every step is a join or an aggregate over many
nodes; a node gathers the digests of one range or of ``FANOUT`` children, never a whole file. Null payloads
are empty; null ids are written as such; digests without a file or an offset take no part. Equal roots give an
empty report. Records that repeat at one offset are compared as a set.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.frames import discard, written
from folioscope.session import scratch_path
from folioscope.sources.files import list_files
from folioscope.sources.ranges import BATCH_BYTES, MOST_BYTES, open_file

SPAN = 1 << 18
FANOUT = 16
PER_FILE = 1000
BREAK = "\r\n\r\n"
#: Leading digits of a digest by which one id's records are added up before they are placed.
PART_DIGITS = 3
#: Equal records placed by one row before they are dealt out.
COPIES = 4096
#: Longest headers of a record, and bytes read at a time.
HEADER_BYTES = 1 << 20


def warc_record(identity: Column, url: Column, payload: Column) -> Column:
    """One response record, without the two line breaks that end it."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(identity.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK), body)


def page_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, page_id, record): pages in files of ``per_file`` consecutive ids; those without an id in files of their own."""
    file = F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1) - F.pmod(F.xxhash64("url", "html"), F.lit(997))).cast("bigint")
    return pages.select(file.alias("file"), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def record_size(record: Column) -> Column:
    """Bytes a record takes in a file, with the line breaks that end it."""
    return (F.octet_length(record) + len(BREAK)).cast("bigint")


def warc_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file, offset, page_id, record) for ``write_warc``, in order of id, then digest. Brings the records of a file
    together, as writing does; ``placed`` gives the same offsets without moving records."""
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(record_size(F.col("record"))).over(before), F.lit(0)).cast("bigint")
    return page_records(pages, per_file).select("file", offset.alias("offset"), "page_id", "record")


def placed(hashed: DataFrame, *carried: str) -> DataFrame:
    """(file, offset, digest, carried...) of records given as (file, page_id, size, digest, carried...), in the order of
    ``warc_records``.

    Equal records are counted before the shuffle. Sizes are added up by id and leading digits of the digest, placed
    within the file, and only then within such a part; so an id that holds a third of all rows is spread over
    16^PART_DIGITS parts, and copies of one record over blocks of ``COPIES``.
    """
    key = F.struct(F.col("page_id").alias("id"))  # a struct: unknown ids are equal and come first
    part = F.substring("digest", 1, PART_DIGITS)
    keyed = hashed.select("file", key.alias("key"), part.alias("part"), "digest", F.col("size").cast("bigint").alias("size"), *carried)
    counted = written(keyed.groupBy("file", "key", "part", "digest", "size", *carried).agg(F.count("*").alias("copies")), "counted")
    taken = F.col("copies") * F.col("size")
    earlier = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("key", "part").rowsBetween(*earlier)
    in_part = Window.partitionBy("file", "key", "part").orderBy("digest").rowsBetween(*earlier)
    parts = counted.groupBy("file", "key", "part").agg(F.sum(taken).alias("total")).select(
        "file", "key", "part", F.coalesce(F.sum("total").over(in_file), F.lit(0)).alias("base"))
    first = F.col("base") + F.coalesce(F.sum(taken).over(in_part), F.lit(0))
    starts = counted.join(parts, ["file", "key", "part"]).select("file", first.alias("first"), "digest", "size", "copies", *carried)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES)))
    dealt = starts.withColumn("block", blocks).withColumn("first", F.col("first") + F.col("block") * COPIES * F.col("size")).withColumn(
        "copies", F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - F.col("block") * COPIES))
    rows = dealt.repartition("file", "first").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return written(rows.select("file", (F.col("first") + F.col("copy") * F.col("size")).alias("offset"), "digest", *carried), "placed")


def write_warc(records: DataFrame, path: str) -> None:
    """One uncompressed WARC folder per file number; each record ends with two line breaks."""
    ordered = records.repartition("file").sortWithinPartitions("file", "offset")
    ordered.select("file", "record").write.partitionBy("file").option("lineSep", BREAK).text(path)


def _stream(path: str) -> BinaryIO:
    file = io.BufferedReader(open_file(path), HEADER_BYTES)  # type: ignore[arg-type]
    return gzip.GzipFile(fileobj=file) if path.endswith(".gz") else file  # type: ignore[return-value]


def _records(stream: BinaryIO, payloads: bool) -> Iterator[tuple]:
    """(offset, size, digest, headers, payload, error) of one stream's records, up to the first error.

    A record's digest is taken as it is read, so a record of any size needs no more than its payload in memory, and
    nothing of it where payloads are not wanted or do not fit into a row.
    """
    at = 0
    while True:
        head, start = b"", at
        while not head.endswith(BREAK.encode()):
            line = stream.readline(HEADER_BYTES)
            at += len(line)
            if not head and line in (b"\r\n", b"\n"):
                start = at
                continue
            head += line
            if not line or len(head) > HEADER_BYTES or not head.startswith(b"WARC/"[: len(head)]):
                break
        if not head:
            return
        fields = [f.split(":", 1) for f in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in f]
        headers = [(k.strip(), v.strip()) for k, v in dict(fields).items()]
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not head.startswith(b"WARC/") or not head.endswith(BREAK.encode()) or not re.fullmatch("[0-9]{1,18}", length):
            yield start, None, None, None, None, "no record header"
            return
        left, digest, parts = int(length), hashlib.sha256(head), []
        kept = payloads and left <= MOST_BYTES
        while left and (data := stream.read(min(left, HEADER_BYTES))):
            left -= len(data)
            at += len(data)
            digest.update(data)
            if kept:
                parts.append(data)
        if left:
            yield start, None, None, headers, None, "record ends early"
            return
        error = "payload longer than a row" if payloads and not kept else None
        yield start, at - start, digest.hexdigest(), headers, b"".join(parts) if kept else None, error


WARC_SCHEMA = "file string, offset bigint, size bigint, digest string, headers map<string,string>, payload binary, error string"
_KINDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("digest", pa.string()),
                    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all WARC files below a path, plain or ``.gz``: file, offset and size in the uncompressed file, digest,
    headers, payload, error.

    ``file`` is the path below ``path`` without the name of a Spark part, so replicas in two folders compare; its
    digests go into ``store`` as they are. A file is one task's stream of records, as records can be told apart only
    from the front, and one record is held at a time. What cannot be read gives a row with an error in its place and
    ends its file; a payload too long for a row is null, with an error and its digest. A repeated header keeps its last value.
    """
    root = re.sub(r"\A[A-Za-z0-9]+:/*", "", path).strip("/") + "/"
    below = F.regexp_replace(F.expr("substr(path, locate(root, path) + length(root))"), r"/part-[^/]*\z", "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for place, name in zip(batch.column("path").to_pylist(), batch.column("file").to_pylist()):
                for record in _guarded(place, payloads):
                    rows.append((name, *record))
                    held += len(record[4] or b"") + HEADER_BYTES // 1024
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KINDS)], schema=_KINDS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KINDS)], schema=_KINDS)

    files = list_files(spark, path).withColumn("root", F.lit(root)).select("path", below.alias("file"))
    return files.mapInArrow(read, WARC_SCHEMA)


def _guarded(path: str, payloads: bool) -> Iterator[tuple]:
    reached = 0
    try:
        with _stream(path) as stream:
            for record in _records(stream, payloads):
                reached = record[0] + (record[1] or 0) + len(BREAK)
                yield record
    except (OSError, EOFError, gzip.zlib.error) as problem:  # type: ignore[attr-defined]
        yield reached, None, None, None, None, f"unreadable: {type(problem).__name__}"


def digests(records: DataFrame, *carried: str) -> DataFrame:
    """(file, offset, digest, carried...) of the records."""
    return records.select("file", "offset", F.sha2("record", 256).alias("digest"), *carried)


class Tree(NamedTuple):
    """A replica as stored: digests (file, offset, digest), nodes (file, node, hash, level), and its highest level."""

    digests: DataFrame
    nodes: DataFrame
    top: int
    span: int
    fanout: int


def open_tree(spark: SparkSession, folder: str, span: int = SPAN, fanout: int = FANOUT) -> Tree:
    """A stored replica; ``span`` and ``fanout`` are those it was stored with."""
    nodes = spark.read.parquet(f"{folder}/nodes")
    top = nodes.agg(F.max("level")).first()[0]
    return Tree(spark.read.parquet(f"{folder}/digests"), nodes, int(top or 0), span, fanout)


def store(hashed: DataFrame, folder: str | None = None, span: int = SPAN, fanout: int = FANOUT) -> Tree:
    """Write a replica's digests and the nodes of every level, from the leaves up to the one where each file has one node.

    Each level is made from the one below as written, so a lost executor repeats one level at most.
    """
    spark = hashed.sparkSession
    folder = folder or scratch_path(spark, "replica")
    hashed.select("file", "offset", "digest").dropna("any").write.parquet(f"{folder}/digests")
    kept = spark.read.parquet(f"{folder}/digests")
    furthest = kept.agg(F.max("offset")).first()[0] or 0

    def joint(at: str, value: str) -> Column:
        gathered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("hash"))))
        return F.sha2(F.array_join(F.transform(gathered, lambda s: F.concat_ws(":", s["at"], s["hash"])), ","), 256).alias("hash")

    level, rows = 0, kept.groupBy("file", F.floor(F.col("offset") / span).alias("above")).agg(joint("offset", "digest"))
    while True:
        rows.withColumnRenamed("above", "node").write.parquet(f"{folder}/nodes/level={level}")
        if furthest < span * fanout**level:
            return open_tree(spark, folder, span, fanout)
        below = spark.read.parquet(f"{folder}/nodes/level={level}")
        rows = below.groupBy("file", F.floor(F.col("node") / fanout).alias("above")).agg(joint("node", "hash"))
        level += 1


def differing_leaves(left: Tree, right: Tree) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(file, node) of the leaves that differ, and for each level from the top (level, nodes compared, nodes that differ).

    Below the top only children of differing nodes are compared. Trees of unequal height meet at the lower one's top.
    """
    if (left.span, left.fanout) != (right.span, right.fanout):
        raise ValueError("replicas are stored with different spans or fanouts")
    branches, seen = None, []
    for level in range(min(left.top, right.top), -1, -1):
        a, b = (t.nodes.where(F.col("level") == level).select("file", "node", F.col("hash").alias(name)) for t, name in ((left, "a"), (right, "b")))
        if branches is not None:
            within = branches.withColumnRenamed("node", "up")
            a, b = (x.withColumn("up", F.floor(F.col("node") / left.fanout)).join(within, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        compared = written(a.join(b, ["file", "node"], "full").select("file", "node", F.col("a").eqNullSafe(F.col("b")).alias("equal")), "branches")
        if branches is not None:
            discard(branches)
        branches = compared.where(~F.col("equal")).select("file", "node")
        seen.append((level, *compared.agg(F.count("*"), F.count_if(~F.col("equal"))).first()))
    return branches, seen


def compare(left: Tree, right: Tree) -> DataFrame:
    """Where two stored replicas differ: file, offset, status, left_digest, right_digest."""
    leaves, _ = differing_leaves(left, right)
    a, b = (
        side.digests.withColumn("node", F.floor(F.col("offset") / side.span)).join(leaves, ["file", "node"], "left_semi")
        .groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias(name))
        for side, name in ((left, "left_digest"), (right, "right_digest")))
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("altered")
    both = a.join(b, ["file", "offset"], "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
    return both.select("file", "offset", status.alias("status"), "left_digest", "right_digest")


def audit(left: DataFrame, right: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas' digests (file, offset, digest) differ, as ``compare`` of their stored trees."""
    return compare(store(left, None, span, fanout), store(right, None, span, fanout))
