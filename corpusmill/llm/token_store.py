"""Token-id files: bit-plane shuffled blocks, zstandard planes and a chunk index.

A *segment* holds the ids of whole consecutive documents (documents are never split, so a
segment closes at the first document end at or past ``segment_ids`` ids).  Its ids, unsigned
32-bit, are cut into blocks of ``block_ids``; each block is transposed into byte planes
(plane p holds byte p of every id) or bit planes (plane p holds bit p of every id, packed),
and each plane is compressed with zstandard; planes that are all zero take no bytes.

Segment bytes, little-endian::

    magic "BPT1" | mode u8 (0 byte planes, 1 bit planes) | 3 zero bytes | block_ids u32 | n_blocks u32
    chunk index: for each block  n_ids u32, then one u32 length for each plane
    planes, in the order of the index

Segments are the binary rows of a Parquet table (``shard``, ``segment``, ``doc_ids``,
``doc_lengths``, ``payload``) written by Spark's own writer, so any store that Spark reads
holds it and a lost task is simply written again; shards follow ascending doc_id.

Defined results: null text is the empty text (the end id alone); rows with a null doc_id come
first; equal doc_ids are ordered by a hash of their text; repeated rows each stand; an empty
table gives an empty store.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ChunkMemo, forgettable, portions, written

MAGIC = b"BPT1"
#: The starts of up to this many segments (16 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000
HEAD = struct.Struct("<4sB3xII")
#: Bytes of a text that is held against the library, at most.
CHECKED = 4096
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
BYTE_LEVEL = {b: 0x122 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 0x143}


def pack_segment(ids: bytes, block_ids: int = 65536, bits: bool = False, level: int = 3) -> bytes:
    """One segment of little-endian unsigned 32-bit ids."""
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    values = np.frombuffer(ids, dtype="<u4")
    index, planes = [], []
    for at in range(0, len(values), block_ids):
        block = values[at : at + block_ids]
        as_bytes = block.view(np.uint8).reshape(-1, 4)
        if bits:
            rows = np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            rows = as_bytes.T
        index.append(len(block))
        for row in rows:
            plane = press(np.ascontiguousarray(row).tobytes()) if row.any() else b""
            index.append(len(plane))
            planes.append(plane)
    n_blocks = -(-len(values) // block_ids)
    return b"".join([HEAD.pack(MAGIC, int(bits), block_ids, n_blocks), np.array(index, dtype="<u4").tobytes(), *planes])


def unpack_segment(payload: bytes) -> bytes:
    """The ids of a segment as little-endian unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    magic, bits, _, n_blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    n_planes = 32 if bits else 4
    index = np.frombuffer(payload, "<u4", n_blocks * (n_planes + 1), HEAD.size).reshape(n_blocks, n_planes + 1)
    expand = zstandard.ZstdDecompressor().decompress
    at, out = HEAD.size + index.nbytes, []
    for n, *sizes in index.tolist():
        width = -(-n // 8) if bits else n
        rows = np.zeros((n_planes, width), np.uint8)
        for p, size in enumerate(sizes):
            if size:
                rows[p] = np.frombuffer(expand(payload[at : at + size], max_output_size=width), np.uint8)
                at += size
        if bits:
            flat = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
        else:
            flat = rows.T
        out.append(np.ascontiguousarray(flat).tobytes())
    return b"".join(out)


#: Texts that show at loading whether a tokenizer file may be used word by word.
PROBES = ["", " ", "Two words, and 12 more.", "x,y. z. don't 'Tis they'll''s", "caf\u00e9 \u00c9t\u00e9 stra\u00dfe", "a\n\nb\tc", "\u65e5\u672c\u8a9e w\u3000v", "A-b_c (d) [e]; f: \"g\" 3.5% #1"]


class WordEncoder:
    """Whole-text ids of a ``tokenizers`` file whose pre-tokens never span ASCII white space.

    Text is cut at ASCII white space; each part is encoded once by the library and remembered.
    Parts are ASCII-lower-cased first (the vocabulary's normaliser lower-cases anyway) unless
    they may hold a special token, and a final full stop or comma after a letter is a pre-token
    of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.stops: dict[int, bytes] = {}
        self.memo = ChunkMemo(self._solve, 500_000)
        #: Files that are not of this kind are encoded text by text by the library.
        self.by_words = all(self._by_words(p) == self._whole([p])[0] for p in PROBES)

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _solve(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        odd = []
        for i, c in enumerate(chunks):
            tail = b""
            if c[-1] in b".," and len(c) > 1:
                word = self._letters(c[:-1])
                if word and c[-1] not in self.stops:
                    self.stops[c[-1]] = self._whole([chr(c[-1])])[0]
                tail = self.stops.get(c[-1], b"")
            else:
                word = self._letters(c)
            if word:
                out[i] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)]) + tail
            else:
                odd.append(i)
        for i, ids in zip(odd, self._whole([chunks[i].decode("utf-8") for i in odd]) if odd else []):
            out[i] = ids
        return out

    @staticmethod
    def _letters(chunk: bytes) -> str:
        """A word of a-z and lower Latin-1 letters in byte-level form, else "".

        Such a word is one pre-token and the normaliser leaves it as it is, so it can go to the
        library's model at once.  Of its bytes, byte-level form shows a-z and C3, and the bytes
        80-A0 and AD shifted to U+0122-0142 and U+0143.
        """
        if chunk.isalpha():
            return chunk.decode("ascii").lower()
        word = chunk.decode("utf-8").lower()
        return word.encode("utf-8").decode("latin-1").translate(BYTE_LEVEL) if LETTERS(word) else ""

    def encode(self, text: str) -> bytes:
        return self._by_words(text) if self.by_words else self._whole([text])[0]

    def check(self, text: str) -> None:
        """Raises an error if the library gives the text other ids."""
        if self.by_words and self._by_words(text) != self._whole([text])[0]:
            raise RuntimeError("the tokenizer file does not encode word by word")

    def _by_words(self, text: str) -> bytes:
        data = text.encode("utf-8")
        return self.memo.encode((data if b"<|" in data else data.lower()).split())


_loaded: dict[str, WordEncoder] = forgettable({})


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


SEGMENTS = "shard int, segment int, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids bigint, payload binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, shards: int | None = None, segment_ids: int = 1 << 20, block_ids: int = 65536, bits: bool = False, path: str | None = None) -> str:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order and writes the store; returns its path."""
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        encode = encoder.encode
        shard, segment = TaskContext.get().partitionId(), 0
        ids, lengths, codes, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([pack_segment(b"".join(codes), block_ids, bits)], pa.binary())],
                names=["shard", "segment", "doc_ids", "doc_lengths", "n_ids", "payload"],
            )

        for batch in portions(batches, 1):
            # one text of each portion is held against the library: the longest of up to CHECKED bytes, else the shortest
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            near = np.where(sizes <= CHECKED, sizes, -1)
            encoder.check(batch.column(1)[int(near.argmax() if near.max() > 0 else sizes.argmin())].as_py() or "")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = encode(text.as_py() or "") + end
                ids.append(doc_id)
                lengths.append(len(code) // 4)
                codes.append(code)
                held += len(code) // 4
                if held >= segment_ids:
                    yield row()
                    segment += 1
                    ids, lengths, codes, held = [], [], [], 0
        if ids:
            yield row()

    segments = ordered.mapInArrow(run, SEGMENTS)
    if path is None:
        return written(segments, "tokens")
    segments.write.option("compression", "uncompressed").parquet(path)
    return path


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, segment and how many ids stand before the segment in the whole store.

    Shard totals (one number a shard) are summed up on the driver.
    """
    segments = spark.read.parquet(path).select("shard", "segment", "n_ids")
    totals = sorted((r[0], r[1]) for r in segments.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, before = {}, 0
    for shard, n in totals:
        base[shard], before = before, before + n
    from pyspark.sql import Window as W

    own = F.sum("n_ids").over(W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    bases = spark.createDataFrame(list(base.items()), "shard int, base bigint")
    return segments.withColumn("own", F.coalesce(own, F.lit(0))).join(bases, "shard").select("shard", "segment", (F.col("base") + F.col("own")).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian u32) of each stored document."""
    index = chunk_index(spark, path)
    small = spark.read.parquet(path).select("shard").count() <= BROADCAST_SEGMENTS
    segments = spark.read.parquet(path).join(F.broadcast(index) if small else index, ["shard", "segment"]).select("start", "doc_ids", "doc_lengths", "payload")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                start, doc_ids, lengths, payload = (batch.column(k)[r].as_py() for k in range(4))
                flat = unpack_segment(payload)
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - np.array(lengths, np.int64)
                pieces = [flat[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the store of ``docs`` and returns doc_id, start, n_tokens and ids_crc32 as read back from it."""
    path = write_tokens(docs, tokenizer_path)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
