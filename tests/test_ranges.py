"""Files looked into by byte ranges."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.plans import jobs
from folioscope.sources import files as src
from folioscope.sources.ranges import range_of, with_range

BIG = 3 * 2**30


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("up load%20")
    (root / "a.txt").write_bytes("é\r\nzwei\n".encode() * 4000)
    (root / "bad.txt").write_bytes(b"x" * 2_000_000 + b"\xff")
    (root / "edge.md").write_bytes("\U0001f600".encode() * 9000)
    (root / "o.json").write_text('{"a": 1, "b": 2}')
    (root / "no.json").write_text("{oops")
    (root / "t.csv").write_text('id,"x\ny"\n' + "1,2\n" * 9)
    (root / "plain.bin").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(root / "z.bin", "w") as archive:
        for i in range(40):
            archive.writestr(f"part-{i}", "x" * 500)
    for name, head, tail in (("big.csv", b"a,b\n" + b"1,2\n" * 9, b""), ("big.txt", b"first\n", b""), ("big.bin", b"", b"PK\x05\x06" + bytes(18))):
        with open(root / name, "wb") as file:  # sparse: next to no disk
            file.write(head)
            file.truncate(BIG)
            file.seek(BIG)
            file.write(tail)
    return root


def named(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_ranges(spark, folder):
    path = str(folder / "t.csv")
    whole = open(path, "rb").read()
    for start, size in ((0, 5), (3, 4), (-6, 6), (-10**6, 10**6), (10**6, 5), (0, 0)):
        assert range_of(f"file:{path}", start, size) == (whole[start:] if start < 0 else whole[start : start + size])[:size]
    files = src.list_files(spark, str(folder)).withColumn("tags", F.array(F.lit("t")))
    got = named(with_range(files, "tail", F.lit(-4), F.when(F.col("length") < BIG, F.lit(4))).collect())
    assert len(got) == 11 and got["o.json"].tail == b": 2}"
    assert got["big.csv"].tail is None and got["plain.bin"].tail == b"\x00\x01" and got["a.txt"].tags == ["t"]
    assert with_range(files.limit(0), "tail", F.lit(0), F.lit(1)).count() == 0
    odd = spark.createDataFrame([(None, 1), (str(folder / "o.json"), 1)], "path string, n int")
    assert sorted(len(r.c or b"") for r in with_range(odd, "c", F.lit(0), F.lit(3)).collect()) == [0, 3]


def test_job_of_listed_files(spark, folder):
    declared = F.when(F.col("path").endswith(".csv"), "application/vnd.ms-excel")
    files = src.list_files(spark, str(folder)).where(~F.col("path").endswith("big.txt")).withColumn("declared_type", declared)
    out = {k: named(v.collect()) for k, v in jobs.file_job(files).items() if k != "chunks"}
    small = src.read_files(spark, str(folder), "{[!b]*,bad.txt}").withColumn("declared_type", declared)
    with_content = {k: named(v.collect()) for k, v in jobs.file_job(small).items() if k != "chunks"}
    for kind, rows in with_content.items():
        assert {n: r for n, r in out[kind].items() if not n.startswith("big.")} == rows, kind
    assert out["tables"]["t.csv"].preview_rows == [["id", "x\ny"]] + [["1", "2"]] * 4
    assert out["text"]["bad.txt"].encoding_used == "utf-8-replace" and out["text"]["edge.md"].text_preview == "\U0001f600" * 4000
    assert out["inventory"]["big.bin"].category == "archive" and out["inventory"]["big.bin"].size_bytes == BIG + 22
    assert out["tables"]["big.csv"].preview_rows[:2] == [["a", "b"], ["1", "2"]]
    assert len(out["archives"]["z.bin"].archive_entries) == 30 and out["archives"]["big.bin"].archive_entries == []
    scan = jobs.file_job(files)["inventory"]._jdf.queryExecution().toString()
    assert "content" not in scan.split("== Physical Plan ==")[1]


def test_header_at_the_end_of_a_large_image(spark, tmp_path):
    tags = ((256, 8), (257, 9), (258, 8), (262, 2), (277, 3))
    with open(tmp_path / "late.tif", "wb") as file:
        file.write(b"II*\x00" + struct.pack("<I", 2**31))
        file.seek(2**31)
        file.write(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHIHH", t, 3, 1, v, 0) for t, v in tags))
    assert os.stat(tmp_path / "late.tif").st_size > 2**31
    (row,) = src.image_metadata(spark, str(tmp_path)).collect()
    assert (row.width, row.height, row["mode"], row.image_error) == (8, 9, "RGB", None)
