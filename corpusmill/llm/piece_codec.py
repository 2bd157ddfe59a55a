"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs ordered by the score of the
piece they would form, leftmost first among equal scores, and merges the best pair until
none is left.  Characters outside the vocabulary become byte pieces.  A piece never holds
the space mark after another character, nor a line break, so those are boundaries no merge
crosses; text is cut there and the encodings of the parts are remembered in a bounded memo.
If a vocabulary breaks that rule, whole texts go through the agenda.

Every Arrow batch is checked against the sentencepiece library: its first text and every
``check_every``-th one must give the library's ids, else the task fails.

Defined results: null and empty texts give no ids and the empty decoded text.  Repeated
rows each give their own row.  An empty table gives an empty table.  Columns named like the
outputs are replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import ChunkMemo, forgettable, kept_and, lean, portions

SPACE = "▁"


class MergeVocabulary:
    """Pieces and scores of a merge-type model, and the agenda that applies them."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.piece_id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece_id[piece] = i
                self.score[piece] = sp.get_score(i)
        self.separable = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece_id)
        self._parts = re.compile(rb"\n| *[^ \n]+| +").findall
        self.memo = ChunkMemo(lambda chunks: [self._encoded(c) for c in chunks])

    def _encoded(self, chunk: bytes) -> bytes:
        return array("i", self.merge(chunk.decode("utf-8").replace(" ", SPACE))).tobytes()

    def merge(self, text: str) -> list[int]:
        """Ids of ``text`` (spaces already marked), by the score-ordered agenda."""
        symbols: list[str | None] = list(text)
        n, score = len(symbols), self.score.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            if (s := score(pair)) is not None:
                agenda.append((-s, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != len(pair):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score(joined := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (-s, i, joined))
            if (h := before[i]) >= 0 and (s := score(joined := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, joined))
        ids: list[int] = []
        for x in symbols:
            if x is not None:
                known = self.piece_id.get(x)
                if known is None:
                    ids.extend(self.byte_id[b] for b in x.encode("utf-8"))
                else:
                    ids.append(known)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit integers."""
        if not text:
            return b""
        data = b" " + text.replace(SPACE, " ").encode("utf-8")
        return self.memo.encode(self._parts(data)) if self.separable else self._encoded(data)


_loaded: dict[str, MergeVocabulary] = forgettable({})


def _vocabulary(path: str) -> MergeVocabulary:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = MergeVocabulary(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded", check_every: int = 64, keep_memo: bool = True) -> DataFrame:
    """``docs`` without ``text`` and with its piece ids and the library's decoding of them; without ``keep_memo`` a task leaves nothing in its worker."""
    source, back = kept_and(docs, text, (ids, decoded))
    kept = source.columns[:-1]
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    at_text = len(kept)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        vocabulary = _vocabulary(model_path)
        decode, check = vocabulary.library.decode, vocabulary.library.encode
        for batch in portions(batches, at_text):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            codes = list(map(vocabulary.encode, texts))
            values = np.frombuffer(b"".join(codes), dtype=np.int32)
            ends = np.cumsum([len(c) // 4 for c in codes], dtype=np.int64) if codes else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            plain = []
            for i, c in enumerate(codes):
                own = memoryview(c).cast("i").tolist()
                if i % check_every == 0 and own != check(texts[i]):
                    raise RuntimeError("the agenda's ids differ from the sentencepiece library's")
                plain.append(decode(own) if own else "")
            id_column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
            columns = [*batch.columns[:-1], id_column, pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, decoded])

    return source.mapInArrow(run if keep_memo else lean(run), schema).select(*back, ids, decoded)


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    coded = encode_decode(docs.select("doc_id", "text"), model_path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
