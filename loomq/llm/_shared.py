"""What the corpus operators have in common: scratch tables in the shared folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: A word of the corpus contracts: a run of anything but these six characters. The same set as a Java and a Python pattern.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_splits(df: DataFrame) -> int:
    """How many partitions the input is read in: grows with its bytes, at maxPartitionBytes each."""
    return max(1, df.rdd.getNumPartitions())


def slices(texts: pa.Array, most: int = 8 << 20):
    """(first row, rows) runs of a string array of about `most` bytes each, one row at least."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to - at
        at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a string array without nulls: word offsets per row, each word's place in the dictionary, the dictionary.

    Words are the runs between the six ASCII white spaces; empty strings between neighbouring spaces are left out.
    """
    parts = pc.ascii_split_whitespace(texts)
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty[codes]
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], kept[offsets]
    return offsets, codes, words


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) over all (s, n)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(df: DataFrame, column: str = "text") -> F.Column:
    return F.coalesce(df[column], F.lit(""))
