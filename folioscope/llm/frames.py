"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import written


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(k1, k2, doc_id, text): a 128-bit key per (id, text), the columns under fixed names.

    The key keeps rows apart that share a null or repeated id; rows equal in both columns share
    it and get the same result. Other columns are pruned, whatever their names.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return base.select(
        F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "doc_id", "text"
    )


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later read needs."""
    for table in tables:
        files = table.inputFiles()
        if files:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()  # type: ignore[union-attr]
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)  # type: ignore[attr-defined]


#: Size of a filter on hash values, whatever their number; more values only make it less selective.
BITMAP_BITS = 1 << 24


def bitmap(hashes: DataFrame, column: str) -> bytes:
    """Bits of the hashes' low ends; at most BITMAP_BITS positions reach the driver."""
    slots = hashes.select(F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int").alias("slot")).distinct().toArrow()
    bits = np.zeros(BITMAP_BITS, dtype=bool)
    bits[slots.column("slot").to_numpy()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bit is set."""
    slot = hashes & (BITMAP_BITS - 1)
    return np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
