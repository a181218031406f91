"""Bounded-space online packing of token ids into sequences.

Each task keeps at most ``open_windows`` windows. A document's ids are cut into full sequences and a remainder. The
remainder goes to the open window with the least room that still holds it (best fit). When none does, a free place
takes it, and with no place free the fullest window is filled with the remainder's head and emitted. What is open when a task ends is its
leftovers; those of up to ``merge_group`` tasks meet in one task, which fills sequences with them in order.
Only that last sequence of each merge is padded, and one at a power of two needs none.

Tokenization streams: no document's ids are kept but those in open windows, at most ``open_windows * max_tokens``.

Edge cases: a null text is empty; an empty document is one piece with the end id alone; repeated documents are packed
again; an empty table gives no rows; very long documents span many sequences. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidied

MAX_TOKENS = 1024
OPEN_WINDOWS = 32
MERGE_GROUP = 256
END_ID = 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts of these characters alone are split alike by both libraries' character classes; the fast one may encode them.
_PLAIN = re.compile("[\n -~¡-ɏ‐-‧‰-⁞]*")


@functools.lru_cache(maxsize=2)
def _encoders(name: str, ranks_name: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(name))
    special = tuple(t.content for t in exact.get_added_tokens_decoder().values())
    with open(public_tokenizers.path(ranks_name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return exact, special, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """The ids that the tokenizer file gives, its special tokens' names in a text included. Plain texts take a faster path with
    the same vocabulary and ids."""
    exact, special, fast = _encoders(name, ranks_name)
    if _PLAIN.fullmatch(text) and not any(s in text for s in special):
        return fast.encode_ordinary(text)
    return exact.encode(text, add_special_tokens=False).ids


class Packer:
    """Online packing in bounded space. Pieces are (doc_id, start, ids, doc_tokens); emitted sequences are lists of them."""

    def __init__(self, max_tokens: int = MAX_TOKENS, open_windows: int = OPEN_WINDOWS):
        self.max_tokens, self.open_windows = max_tokens, open_windows
        self.windows: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, total: int) -> Iterator[list]:
        """Place ids; yields sequences that became full."""
        at = 0
        while len(ids) - at >= self.max_tokens:
            yield [(doc_id, start + at, ids[at : at + self.max_tokens], total)]
            at += self.max_tokens
        while at < len(ids):
            n = len(ids) - at
            fits = [(self.max_tokens - used, i) for i, (used, _) in enumerate(self.windows) if used + n <= self.max_tokens]
            if fits:
                i = min(fits)[1]
            elif len(self.windows) < self.open_windows:
                self.windows.append((0, []))
                i = len(self.windows) - 1
            else:
                i = max(range(len(self.windows)), key=lambda j: self.windows[j][0])
            used, pieces = self.windows[i]
            take = min(n, self.max_tokens - used)
            pieces.append((doc_id, start + at, ids[at : at + take], total))
            at += take
            if used + take == self.max_tokens:
                self.windows.pop(i)
                yield pieces
            else:
                self.windows[i] = (used + take, pieces)

    def leftovers(self) -> Iterator[tuple]:
        for _, pieces in sorted(self.windows, key=lambda w: -w[0]):
            yield from pieces
        self.windows = []


def _rows(sequence_id: int, pieces: list) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        yield doc_id, start, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()), total, sequence_id, offset
        offset += len(ids)


def _batch(rows: list[tuple], leftover: list[tuple]):
    import pyarrow as pa

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    full = rows + [(d, s, len(i), None, t, None, None) for d, s, i, t in leftover]
    cols = list(zip(*full, strict=True)) or [()] * 7
    ids = [None] * len(rows) + [np.asarray(i, dtype="<u4").tobytes() for _, _, i, _ in leftover]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array(ids, pa.binary())], names=[*names, "ids"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The first pass shuffles nothing and is written once; only leftovers, less than open_windows sequences a task, move.
    """

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, out, seq = Packer(max_tokens, open_windows), [], part << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype=np.uint32)
                for pieces in packer.add(doc_id, ids, 0, len(ids)):
                    out.extend(_rows(seq, pieces))
                    seq += 1
            yield _batch(out, [])
            out = []
        yield _batch([], list(packer.leftovers()))
        _encoders.cache_clear()  # a worker that serves other stages next needs none

    def merge(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, used, pieces, out = (1 << 62) | (part << 32), 0, [], []
        for batch in batches:
            for doc_id, start, total, raw in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype="<u4")
                while len(ids):
                    take = min(len(ids), max_tokens - used)
                    pieces.append((doc_id, start, ids[:take], total))
                    start, ids, used = start + take, ids[take:], used + take
                    if used == max_tokens:
                        out.extend(_rows(seq, pieces))
                        seq, used, pieces = seq + 1, 0, []
            yield _batch(out, [])
            out = []
        yield _batch(list(_rows(seq, pieces)), [])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = stored(rows.mapInArrow(tidied(first), PIECE + ", ids binary").withColumn("part", F.spark_partition_id()), "packed")
    left = one.where(F.col("ids").isNotNull())
    tasks = (one.agg(F.max("part")).first()[0] or 0) + 1
    # hashing neighbouring tasks together bounds each merge by merge_group tasks' leftovers, whatever the table's size
    groups = -(-tasks // merge_group)
    left = left.repartition(groups, F.floor(F.col("part") / merge_group)) if groups > 1 else left.coalesce(1)
    # in one order whatever comes first, so that a merge that runs again gives the same sequences
    left = left.sortWithinPartitions("part", "doc_id", "start", "doc_tokens", "ids")
    return one.where(F.col("ids").isNull()).drop("ids", "part").unionByName(left.drop("part").mapInArrow(tidied(merge), PIECE + ", ids binary").drop("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
