"""The fixity audit over stored trees, placement without records, and WARC files as they lie."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.llm import warc_fixity

PAGES = "page_id long, url string, html string"


def hashed(records):
    return records.select("file", "page_id", warc_fixity.record_size(F.col("record")).alias("size"), F.sha2("record", 256).alias("digest"))


def offsets(df):
    return sorted((r.file, r.offset, r.digest) for r in df.select("file", "offset", "digest").collect())


def test_placement_equals_a_running_sum(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "COPIES", 7)
    rows = [(i % 40, f"u{i % 3}", "x" * (i % 5)) for i in range(400)] + [(None, None, None), (None, "a", None)] + [(5, "hot", "same")] * 60
    pages = spark.createDataFrame(rows, PAGES)
    want = warc_fixity.digests(warc_fixity.warc_records(pages, per_file=9))
    assert offsets(warc_fixity.placed(hashed(warc_fixity.page_records(pages, per_file=9)))) == offsets(want)
    assert warc_fixity.placed(hashed(warc_fixity.page_records(pages.limit(0)))).count() == 0


def test_one_damaged_record_costs_one_branch(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("word "), 40).alias("html"))
    good = warc_fixity.placed(hashed(warc_fixity.page_records(pages, per_file=1000)))
    spot = good.where("file = 1").agg(F.max("offset")).first()[0] // 2
    hit = good.where((F.col("file") == 1) & (F.col("offset") >= spot)).agg(F.min("offset")).first()[0]
    broken = good.withColumn("digest", F.when((F.col("file") == 1) & (F.col("offset") == hit), "damaged").otherwise(F.col("digest")))
    left, right = (warc_fixity.store(d, None, 512, 4) for d in (good, broken))
    leaves, seen = warc_fixity.differing_leaves(left, right)
    assert [differing for _, _, differing in seen] == [1] * (left.top + 1) and left.top >= 4
    assert seen[0][1] == 2 and all(compared <= 4 for _, compared, _ in seen[1:])
    assert [tuple(r) for r in leaves.collect()] == [(1, hit // 512)]
    assert [(r.file, r.offset, r.status) for r in warc_fixity.compare(left, right).collect()] == [(1, hit, "altered")]


def test_stored_trees_are_opened_again_and_may_differ_in_height(spark, tmp_path):
    rows = [Row(file="a", offset=100 * i, digest=f"d{i}") for i in range(200)] + [Row(file="b", offset=0, digest="e")]
    whole = spark.createDataFrame(rows, "file string, offset long, digest string")
    odd = spark.createDataFrame([(None, 1, "x"), ("a", None, "x"), ("a", 1, None)], whole.schema)
    warc_fixity.store(whole.unionByName(odd), str(tmp_path / "left"), 256, 4)
    warc_fixity.store(whole.where("file = 'b' OR offset < 1000"), str(tmp_path / "right"), 256, 4)
    left, right = (warc_fixity.open_tree(spark, str(tmp_path / n), 256, 4) for n in ("left", "right"))
    assert left.top > right.top
    got = sorted((r.file, r.offset, r.status) for r in warc_fixity.compare(left, right).collect())
    assert got == [("a", 100 * i, "missing") for i in range(10, 200)]
    assert warc_fixity.compare(left, left).count() == 0
    with pytest.raises(ValueError):
        warc_fixity.compare(left, left._replace(span=1))


def test_replica_folders_are_read_and_compared(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"é\r\n\r\nWARC/1.0 {i}" * (i % 7)) for i in range(60)], PAGES)
    records = warc_fixity.warc_records(pages, per_file=25)
    for name in ("one", "two"):
        warc_fixity.write_warc(records, str(tmp_path / name))
    one, two = (warc_fixity.read_warc(spark, str(tmp_path / n), payloads=False) for n in ("one", "two"))
    written = [(f"file={f}", o, d) for f, o, d in offsets(warc_fixity.digests(records))]
    assert offsets(one) == written
    assert warc_fixity.audit(one, two).count() == 0
    place = tmp_path / "two" / "file=1"
    part = next(p for p in os.listdir(place) if p.startswith("part-"))
    data = bytearray((place / part).read_bytes())
    second = data.index(b"WARC/1.0\r\nWARC-Type", 10)
    data[second + 20] ^= 1
    (place / part).write_bytes(bytes(data))
    for check in place.glob(".*.crc"):
        check.write_bytes(b"")
    got = warc_fixity.audit(one, warc_fixity.read_warc(spark, str(tmp_path / "two"), payloads=False)).collect()
    assert [(r.file, r.offset, r.status) for r in got] == [("file=1", second, "altered")]


def test_packed_broken_and_foreign_files(spark, tmp_path):
    def record(body, length=None):
        return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (len(body) if length is None else length) + body + b"\r\n\r\n"

    first, second = record(b"one"), record(b"")
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(second))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(record(os.urandom(5000)))[:-900])
    (tmp_path / "early.warc").write_bytes(first + record(b"abc", 90))
    (tmp_path / "foreign.warc").write_bytes(b"<html>" * 100)
    (tmp_path / "nolength.warc").write_bytes(b"WARC/1.0\r\nA: b\r\n\r\n")
    (tmp_path / "notpacked.warc.gz").write_bytes(first)
    found = {}
    for r in sorted(warc_fixity.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.offset):
        found.setdefault(r.file, []).append((r.offset, r.digest and r.payload, r.error is None))
    good = (0, b"one", True)
    assert found["packed.warc.gz"] == [good, (len(first), b"", True)]
    assert found["early.warc"] == [good, (len(first), None, False)]
    assert found["cut.warc.gz"] == [good, (len(first), None, False)]
    assert all(found[n] == [(0, None, False)] for n in ("foreign.warc", "nolength.warc", "notpacked.warc.gz"))
    digest = warc_fixity.read_warc(spark, str(tmp_path / "packed.warc.gz").rsplit("/", 1)[0]).where("file = 'packed.warc.gz' AND offset = 0").first().digest
    assert digest == hashlib.sha256(first[:-4]).hexdigest()
