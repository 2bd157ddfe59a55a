"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut, shared_dir  # noqa: F401  operators take cut from here


def written(df: DataFrame, label: str) -> str:
    """Writes ``df`` as zstd Parquet below the shared folder and returns the path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def reread(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again; smaller there than a checkpoint."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``written`` made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(numbers: str) -> str:
    """The unsigned CRC-32 of a list of byte values in DuckDB, which has no function for it."""
    step = "0"
    for k in range(8):  # what each bit of the lowest byte leaves behind
        left = 1 << k
        for _ in range(8):
            left = (left >> 1) ^ (0xEDB88320 if left & 1 else 0)
        step = f"xor({step}, ((xor(a, x) >> {k}) & 1) * {left})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, x: xor(a >> 8, {step})), 4294967295)"


def set_aside(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but the ``used`` ones under names of our own, and the columns that name them back, in order."""
    names = {c: c if c in used else f"__own{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def kept_and(df: DataFrame, text: str, replaced: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """All columns but ``text`` and those ``replaced``, under names of our own, then ``text``; and the columns that name them back."""
    plain, back = set_aside(df.select(*[F.col(f"`{c}`") for c in df.columns if c != text and c not in replaced]), ())
    named = [F.col(f"`{c}`").alias(n) for c, n in zip([c for c in df.columns if c != text and c not in replaced], plain.columns)]
    return df.select(*named, F.col(f"`{text}`").alias("__text")), back


def portions(batches, column: int, limit: int = 4_000_000):
    """Slices of Arrow batches with about ``limit`` bytes of the string column each, so that a task holds little at once."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


_memos: weakref.WeakSet = weakref.WeakSet()
_models: list[dict] = []


def forgettable(models: dict) -> dict:
    """A dict of loaded models that other operators may empty."""
    _models.append(models)
    return models


def forget_memos() -> None:
    """Gives back what a reused Python worker still holds from earlier operators: memos, models and freed memory."""
    import ctypes

    import pyarrow as pa

    for memo in list(_memos):
        memo.young, memo.old, memo.held = {}, {}, 0
    for models in _models:
        models.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """``run`` of an Arrow map as a task that begins without what earlier operators left in its worker, and leaves nothing there either.

    A worker waits for a minute for more work, beside those of the next stage.
    """

    def tidy(batches):
        forget_memos()
        yield from run(batches)
        forget_memos()

    return tidy


class ChunkMemo:
    """A memo of chunk -> encoded bytes, bounded by two generations of ``size`` entries and ``most`` bytes.

    ``solve`` gets a list of unknown chunks and returns their encodings in order.  Chunks over ``LONGEST`` bytes are rarely seen
    twice and are not remembered, so neither are the long runs of texts without white space.
    """

    #: Bytes of the longest chunk that is remembered, and what an entry takes besides its bytes.
    LONGEST, ENTRY = 256, 200

    def __init__(self, solve, size: int = 250_000, most: int = 96_000_000):
        self.solve, self.size, self.most, self.held = solve, size, most, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        _memos.add(self)

    def encode(self, chunks: list[bytes]) -> bytes:
        found = list(map(self.young.get, chunks))
        if None in found:
            missing = list({c for c, v in zip(chunks, found) if v is None})
            own = {c: v for c in missing if (v := self.old.get(c)) is not None}
            fresh = [c for c in missing if c not in own]
            if fresh:
                own.update(zip(fresh, self.solve(fresh)))
            found = [own[c] if v is None else v for c, v in zip(chunks, found)]
            for c, v in own.items():
                if len(c) <= self.LONGEST:
                    self.young[c] = v
                    self.held += len(c) + len(v) + self.ENTRY
            if len(self.young) > self.size or self.held > self.most:
                self.old, self.young, self.held = self.young, {}, 0
        return b"".join(found)
