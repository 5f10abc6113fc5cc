"""Shared pieces of the text operators: shared folder, row keys, byte-level words.

The word definition used by the vectorised operators is the byte class
``[0-9A-Za-z]`` plus every byte above 0x7F, with A-Z lower-cased: on UTF-8
text this is the run of code points outside
``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsense.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder all executors share and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a Parquet table (columnar and compressed: for wide rows)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabsense-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """SHA-256 of the text as 32 bytes: equal keys stand for equal texts."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def unit_hash(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) from an MD5 of the parts, the same in any engine.

    52 bits of the digest, moved to the middle of their cell so that neither
    0 nor 1 occurs.
    """
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5))
            / F.lit(float(1 << 52)))


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that is kept from training."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds))
                      == fold, F.lit(False))


def bounded_sample(keys: DataFrame, docs: DataFrame, id_col: str, per_label: int) -> DataFrame:
    """``docs`` restricted to a sample of ``keys`` (id, label), with (sample_label, sample_h).

    At most ``per_label`` ids of each label, those with the smallest hash of
    the id, so the choice does not depend on partitioning.  Labels are counted
    first, and of a label of n ids only those whose hash lies in the lowest
    (2 * per_label + 100) / n of its range are ranked: no task sorts a label,
    and fewer than ``per_label`` are left with a chance below 1e-20.  Only ids are
    shuffled, and the chosen ones are few by the bound.
    """
    keys = (keys.where("label is not null and id is not null").distinct()
            .withColumn("h", F.xxhash64(F.lit("sample"), "id")))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_label + 100) / F.col("n"))
    bounds = keys.groupBy("label").agg(F.count("*").alias("n")).select("label", share.alias("share"))
    low = keys.join(bounds, "label").where(
        F.col("h") / 2.0 ** 64 + 0.5 <= F.col("share")).drop("share")
    in_label = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    chosen = (low.withColumn("nth", in_label).where(F.col("nth") <= per_label)
              .select(F.col("id").alias("sample_id"), F.col("label").alias("sample_label"),
                      F.col("h").alias("sample_h")))
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("sample_id")).drop("sample_id")


def excerpt(text: Column, seed: Column, longest: int) -> Column:
    """The text, or ``longest`` characters from a hashed place of a longer one."""
    spare = F.char_length(text) - longest
    start = F.pmod(F.xxhash64(F.lit("excerpt"), seed), F.greatest(spare, F.lit(0)) + 1)
    return F.when(spare <= 0, text).otherwise(
        F.substring(text, (start + 1).cast("int"), F.lit(longest)))


# --- byte-level words (numpy, inside tasks) ---------------------------------

_b = np.arange(256)
IS_WORD = (((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A))
           | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80))
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(arrow_strings) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls have no bytes."""
    import pyarrow as pa

    arr = arrow_strings
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    large = arr.cast(pa.large_string())
    if large.null_count:
        large = large.fill_null("")
    _, off, data = large.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[large.offset:large.offset + len(large) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]],
            offsets - offsets[0])


def spans_of(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true flags; runs do not cross documents."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    starts = np.flatnonzero(flags & (~before | first[:-1]))
    ends = np.flatnonzero(flags & (~after | first[1:])) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               fold: bool = True) -> np.ndarray:
    """64-bit hash of the bytes of every (non-empty) span; ``fold`` ignores the case of A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    powers = np.multiply.accumulate(
        np.full(int(lengths.max()) + 1, _BASE, dtype=np.uint64))
    chars = data[np.repeat(starts, lengths) + inside]
    chars = (LOWER[chars] if fold else chars).astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(chars * powers[inside], heads) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of each document + total)."""
    starts, ends = spans_of(IS_WORD[data], offsets)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def blocks(offsets: np.ndarray, most: int):
    """Ranges of whole documents of about ``most`` bytes (one document at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
