"""Image headers, batch bisection and the outputs of jobs on odd input."""

import struct
import zlib

import pandas as pd
import pytest

from folioscope.functions.imageheader import TooShort, image_header
from folioscope.functions.scoring import bisected
from folioscope.plans import jobs
from folioscope.sources.files import image_metadata

PNG = b"\x89PNG\r\n\x1a\n"


def png(width, height, bits=8, colour=2):
    body = b"IHDR" + struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)
    return PNG + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body)) + b"\x00" * 40


def jpeg(width, height, parts, before=0):
    filler = b"".join(b"\xff\xe1" + struct.pack(">H", min(before - i, 60_000) + 2) + b"x" * min(before - i, 60_000) for i in range(0, before, 60_000))
    return b"\xff\xd8" + filler + b"\xff\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, parts) + b"\x00" * 9 + b"\xff\xda"


def tiff(order, width, height, bits, photo, parts):
    head = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(f"{order}I", 8)
    tags = [(256, width), (257, height), (258, bits), (262, photo), (277, parts)]
    rows = b"".join(struct.pack(f"{order}HHI", t, 3, 1) + struct.pack(f"{order}H", v) + b"\x00\x00" for t, v in tags)
    return head + struct.pack(f"{order}H", len(tags)) + rows


GOOD = [
    (png(7, 9), (7, 9, "RGB")), (png(1, 1, 1, 0), (1, 1, "1")), (png(1, 1, 16, 0), (1, 1, "I;16")), (png(2, 3, 8, 6), (2, 3, "RGBA")),
    (png(2, 3, 8, 3), (2, 3, "P")), (b"BM" + b"\x00" * 12 + struct.pack("<IiiHH", 40, 5, -6, 1, 24), (5, 6, "RGB")),
    (b"BM" + b"\x00" * 12 + struct.pack("<IHHHH", 12, 5, 6, 1, 8), (5, 6, "P")), (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4, "P")),
    (jpeg(30, 40, 3), (30, 40, "RGB")), (jpeg(30, 40, 1, 200_000), (30, 40, "L")), (tiff("<", 8, 9, 8, 2, 3), (8, 9, "RGB")),
    (tiff(">", 8, 9, 1, 1, 1), (8, 9, "1")), (tiff(">", 8, 9, 8, 3, 1), (8, 9, "P")),
]


@pytest.mark.parametrize(("data", "want"), GOOD)
def test_header(data, want):
    assert image_header(data) == want
    for cut in range(0, min(len(data), 60), 3):  # any beginning is refused or too short, or already enough
        try:
            assert image_header(data[:cut]) == want
        except (TooShort, ValueError):
            pass


@pytest.mark.parametrize("data", [b"", b"text", png(0, 5), png(3, 3, 8, 9), b"\xff\xd8\x00\x00\x00", jpeg(1, 1, 2)])
def test_no_image(data):
    with pytest.raises(ValueError):
        image_header(data)


def test_files_keep_a_row(spark, tmp_path):
    for i, (data, _) in enumerate(GOOD):
        (tmp_path / f"{i}.img").write_bytes(data)
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "cut.jpg").write_bytes(jpeg(30, 40, 3, 100_000)[:70_000])
    got = {r.path.rsplit("/", 1)[1]: r for r in image_metadata(spark, str(tmp_path)).collect()}
    assert len(got) == len(GOOD) + 1  # Spark gives no row for a file without bytes
    for i, (_, want) in enumerate(GOOD):
        r = got[f"{i}.img"]
        assert (r.width, r.height, r["mode"], r.image_error) == (*want, None)
    assert got["cut.jpg"].image_error and got["cut.jpg"].width is None


def test_bisection_calls_few_batches():
    calls = []

    def score(batch):
        calls.append(len(batch))
        if (batch < 0).any():
            raise ArithmeticError("negative")
        return batch * 2

    values = pd.Series(range(4096))
    values[[5, 6, 3000]] = -1
    out, errors = bisected(score, values, None)
    assert [i for i, e in enumerate(errors) if e] == [5, 6, 3000] and errors[5] == "ArithmeticError: negative"
    assert [out[i] for i in (4, 5, 7, 4095)] == [8, None, 14, 8190]
    assert len(calls) <= 2 * 3 * 12 + 1
    calls.clear()
    assert bisected(score, values.abs(), None)[1] == [None] * 4096 and calls == [4096]
    assert bisected(score, values.iloc[:0], None) == ([], [])
    assert bisected(lambda b: [1], pd.Series([1, 2]), 0)[0] == [1, 1]


def test_pdf_job_names_what_cannot_be_read(spark):
    page = '{"pages": [{"page": 1, "lines": [{"text": "a line", "confidence": 0.5}]}, {"page": 2, "lines": 7}]}'
    docs = spark.createDataFrame([(1, page), (2, "{"), (3, None), (4, '{"pages": []}')], "doc_id long, raw string")
    out = jobs.pdf_job(docs)
    assert {r.doc_id: r.confidence_score for r in out["confidence"].collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}
    assert sorted((r.source_file, r.position) for r in out["errors"].collect() if r.position) == [("1", 2)]
    assert {r.source_file for r in out["errors"].collect()} >= {"1", "2"}
    assert [r.text for r in out["chunks"].collect()] == ["a line"]
