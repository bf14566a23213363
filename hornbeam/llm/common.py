"""Shared pieces of the corpus operators: table access, scratch tables, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, new_path

#: ASCII blanks that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_BATCH, _SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands small Arrow batches to Python workers, also for plans that others write."""
    now = str(spark.conf.get(_BATCH))
    if not (now.isdigit() and 0 < int(now) <= _SMALL):
        spark.conf.set(_BATCH, _SMALL)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    While it is written, Python workers get small Arrow batches: rows may hold whole texts, even two.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_BATCH)
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator reads, under fixed names; extra columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def split_words(text: str | None) -> list[bytes]:
    """``bytes.split`` without arguments splits at exactly the blanks of WORD_PATTERN."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def give_back() -> None:
    """Return memory that is no longer used to the system: an executor's workers share what it may take."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


_memories: dict[str, Callable[[], object]] = {}
_current: list[str] = []


def remembers(owner: str, forget_all: Callable[[], object]) -> None:
    """Say how what an operator keeps in a Python worker is dropped."""
    _memories[owner] = forget_all


def working(owner: str) -> None:
    """A task of this operator begins: what other operators kept in the worker goes, and freed memory is given back."""
    if _current != [owner]:
        for other, drop in _memories.items():
            if other != owner:
                drop()
        _current[:] = [owner]
    give_back()


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (order matters)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[k : k + m] + np.uint64(k + 1))
    return mix(out)


def rows_of(batches: Iterable[pa.RecordBatch], most: int = 512) -> Iterable[pa.RecordBatch]:
    """The same rows in small batches, so that what is derived of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
    give_back()


def together(batches: Iterable[pa.RecordBatch], most: int = 2 << 20) -> Iterable[pa.Table]:
    """The same rows in tables of at least ``most`` bytes (but the last), for work that is cheaper on many."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)
    give_back()


_SLOTS, _SALTS = 1 << 16, 32


def _slot(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(_SLOTS))


def hot_slots(rows: DataFrame, key: str | list[str]) -> list[int]:
    """Slots of the key's hash that hold far more rows than most: 8 times the mean and 4096. That is at most 8,192."""
    key = [key] if isinstance(key, str) else key
    most = 8 * rows.count() / _SLOTS + 4096
    counts = rows.groupBy(_slot(key).alias("slot")).agg(F.count("*").alias("n"))
    return sorted(r["slot"] for r in counts.where(F.col("n") > most).collect())


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], hot: list[int]) -> DataFrame:
    """Inner join of ``many`` rows with the ``one`` of their key; rows of hot slots are dealt over several tasks."""
    key = [key] if isinstance(key, str) else key
    if not hot:
        return many.join(one, key)
    is_hot = _slot(key).isin(hot)
    salted = many.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*many.columns, F.lit(1)), F.lit(_SALTS))).otherwise(0).cast("int"))
    copies = one.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*key, "__salt"]).drop("__salt")
