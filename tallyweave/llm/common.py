"""What the operators of this subpackage share: scratch tables in the cluster's folder, batch helpers, folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.lineage import discard, scratch_dir
from tallyweave.operators.lineage import settled as materialize

__all__ = ["WORD", "batches", "discard", "doc_crc", "documents", "free_names", "hash_share", "materialize", "mix", "quoted", "raw", "scratch_dir"]

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D, the set that bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, made longer until no given column has them in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hash_share(key: Column, rows: int, bound: int, seed: int = 17) -> Column:
    """A condition that keeps about ``bound`` of ``rows`` rows, the same ones on each run."""
    share = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def raw(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from tuples in the order of the schema."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: two multiply and shift rounds."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
