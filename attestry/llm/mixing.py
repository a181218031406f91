"""Language-model scoring by online logistic context mixing.

Tokens are the words of a text and one end. A token's probability is that of its class, eight bits of its hash, times
its own within the class, (c + 0.5) / (C + 0.5 (V + 1)) from exact counts over the whole training corpus. The class is
coded bit by bit. Several predictors give each bit's probability by context: nothing; the word before; the one before
that; the ending and length of the word before; both words before. A mixer adds them in the logistic domain with weights that a
gate, the bit's place, selects; an adaptive map then corrects the result by what was seen at that place at about that probability.
Every text starts from the same trained state; weights and map adapt while it is read, after each
block of ``BLOCK`` tokens, so a score depends on its text and the corpus alone.

What is learned grows with the corpus: every distinct word, and every distinct pair of words before a token, has
counts of its own. The first three contexts are hashed to the fixed ``CONTEXTS``, whose tables are broadcast. A context of two words leans on
the word before, which counts as one sighting, and is that alone where it wasn't seen in training.

Texts are read in batches of about ``BATCH`` bytes, written once. A batch asks for its distinct words and (context, class) keys,
with their training counts, in one blob for each range of keys; a range's task sums them and sends each batch the totals in the
order of its keys. So a key is shuffled once per batch, however often it occurs there, and no task holds more than one
range (about ``RANGE`` bytes of text's worth) or one batch. Words have 64 bits of hash, contexts seven more than the corpus has bytes in
powers of two (56 at most), so that about a thousandth meets another.

Edge cases: a null or empty text is its end token alone; with no training rows every token is unknown; rows that
repeat are scored each; a text longer than ``BATCH`` bytes is read in pieces of that size, with the words before carried and weights
and map started again; a null teach doesn't teach; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, stored, table, tidied
from .shingles import hash_words, mix

BITS = 8
NODES = 1 << BITS
#: Contexts of each predictor with a fixed table: nothing, the word before, the one before that, its ending (a byte) and length up to 15.
CONTEXTS = (1, 2048, 512, 4096)
K = len(CONTEXTS) + 1
OFFSETS = np.concatenate(([0], np.cumsum(CONTEXTS))) * NODES
SLOTS = int(OFFSETS[-1])
CHUNK = 1 << 16
BLOCK = 32
#: Texts that are read side by side.
DOCS = 256
BATCH, RANGE = 2_000_000, 8_000_000
RATE, MAP_RATE, MAP_CELLS = 0.002, 0.02, 24
#: The end token's hash.
END = np.uint64(0x5851F42D4C957F2D)
_PREV2 = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\x0b\x0c\r"


def pieces(text: str | None, most: int = BATCH):
    """(piece, words to skip, whether it is the last, its bytes): a text cut at white space, each piece led by the two words before it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at, lead = 0, b""
    while True:
        end = min(len(raw), at + most)
        while end < len(raw) and raw[end] not in _WHITE:
            end += 1
        piece = raw[at:end]
        yield (lead + piece).decode("utf-8", "surrogatepass"), len(lead.split()), end == len(raw), len(piece)
        if end == len(raw):
            return
        lead, at = b" ".join((lead + piece[-most:]).split()[-2:]) + b" ", end


def _packed(rows: list[tuple]) -> bytes:
    import pyarrow as pa

    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "teach": pa.bool_(), "text": pa.string(), "skip": pa.int64(), "last": pa.bool_(), "bytes": pa.int64()}
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> dict[str, list]:
    import pyarrow as pa

    return pa.ipc.open_stream(blob).read_all().to_pydict()


def _batched(batches):
    """(batch, bytes, blob): texts in batches of about BATCH bytes."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, row, n, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([size]), pa.array([_packed(held)], pa.binary())], names=["batch", "bytes", "blob"])

    for b in batches:
        for i in range(b.num_rows):
            doc_id, text, teach = (b.column(k)[i].as_py() for k in range(3))
            for piece in pieces(text):
                held.append((part << 40 | row, doc_id, bool(teach), *piece))
                size += piece[3]
                if size >= BATCH:
                    yield batch()
                    n, held, size = n + 1, [], 0
            row += 1
    if held:
        yield batch()


class Tokens:
    """Tokens of a batch: hashes, slots of the fixed contexts, keys (context, class) of the two words before, and where texts start."""

    def __init__(self, texts: list[str], skip: list[int], last: list[bool], width: int):
        words, shape, at = hash_words(texts)
        # an end after each text, and zeros before it in the contexts
        ends = at[1:] + np.arange(len(texts))
        h, shapes = np.insert(words, at[1:], END), np.insert(shape, at[1:], np.uint64(0))
        first = ends - np.diff(at)
        p1, p2, s1 = (np.concatenate((np.zeros(k, np.uint64), x))[: len(x)] for k, x in ((1, h), (2, h), (1, shapes)))
        p1[first] = p2[first] = s1[first] = 0
        p2[np.minimum(first + 1, ends)] = 0
        keep = np.ones(len(h), bool)
        keep[ends[~np.array(last, bool)]] = False
        for i in np.flatnonzero(skip):
            keep[first[i] : first[i] + skip[i]] = False
        self.at = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, first, dtype=np.int64))))
        if not keep.all():
            h, p1, p2, s1 = h[keep], p1[keep], p2[keep], s1[keep]
        self.h, high = h, np.uint64(32)
        self.slots = np.stack([OFFSETS[1] + ((p1 >> high) % np.uint64(CONTEXTS[1])).astype(np.int32) * NODES, OFFSETS[2] + ((p2 >> high) % np.uint64(CONTEXTS[2])).astype(np.int32) * NODES, OFFSETS[3] + s1.astype(np.int32) * NODES]).astype(np.int32)
        self.keys = mix(p1 + p2 * _PREV2 + np.uint64(2)) >> np.uint64(64 - width) << np.uint64(BITS) | h & np.uint64(NODES - 1)


def nodes_and_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its class's path: the node before each bit (1 to 255), and the bits."""
    cls = (h & np.uint64(NODES - 1)).astype(np.int32) | NODES
    shifts = np.arange(BITS, 0, -1, dtype=np.int32)
    nodes = cls[:, None] >> shifts
    return nodes, (cls[:, None] >> (shifts - 1)) & 1


def range_of(keys: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Which of the parts, in the order of the keys, each key of that many bits falls in."""
    return (keys >> np.uint64(width - 32)) * np.uint64(parts) >> np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    """Little-endian numbers with equal bytes together: mostly zeros, which compress well."""
    raw = np.ascontiguousarray(x).view(np.uint8)
    return b"".join(raw[i :: x.itemsize].tobytes() for i in range(x.itemsize))


def _numbers(raw: bytes, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    x, out = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n), np.empty(n * size, np.uint8)
    for i in range(size):
        out[i::size] = x[i]
    return out.view(kind), at + n * size


def _zipped(sizes: tuple[int, ...], *arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(np.array(sizes, "<u4").tobytes() + b"".join(map(_planes, arrays)))


def _unzipped(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


_SHAPE = "part int, kind int, key long, blob binary"
QUESTION, TABLE, CLASSES = 0, 1, 2


def _rows(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "kind", "key", "blob"])


def _ask(width: int, parts: int):
    """Each batch's distinct words and keys with their training counts, by range; at the end the task's fixed tables, by chunk."""

    def run(batches):
        tables = np.zeros((SLOTS, 2), np.uint32)
        for b in batches:
            for batch, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs = _unpacked(blob)
                t = Tokens(docs["text"], docs["skip"], docs["last"], width)
                teach = np.repeat(np.array(docs["teach"], bool), np.diff(t.at))
                asked = []
                for keys, bits in ((t.h, 64), (t.keys, width + BITS)):
                    u, inverse = np.unique(keys, return_inverse=True)
                    n = np.bincount(inverse, teach, len(u)).astype(np.uint32)
                    asked.append((u, n, np.searchsorted(range_of(u, bits, parts), np.arange(parts + 1))))
                out = []
                for p in range(parts):
                    mine = [(u[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]) for u, n, cut in asked]
                    if len(mine[0][0]) or len(mine[1][0]):
                        out.append((p, QUESTION, batch, _zipped([len(u) for u, _ in mine], *(x for u, n in mine for x in (_steps(u), n)))))
                yield _rows(out)
                for i in range(0, len(t.h), 1 << 18):
                    some = slice(i, i + (1 << 18))
                    nodes, bits = nodes_and_bits(t.h[some][teach[some]])
                    code = nodes * 2 + bits
                    tables[:NODES] += np.bincount(code.ravel(), minlength=2 * NODES).reshape(-1, 2).astype(np.uint32)
                    for k in range(1, K - 1):
                        lo, hi = OFFSETS[k], OFFSETS[k + 1]
                        at = (t.slots[k - 1][some][teach[some], None] - lo) * 2 + code
                        tables[lo:hi] += np.bincount(at.ravel(), minlength=2 * (hi - lo)).reshape(-1, 2).astype(np.uint32)
        chunks = [(c, tables[c * CHUNK : (c + 1) * CHUNK]) for c in range(-(-SLOTS // CHUNK))]
        yield _rows([(c % parts, TABLE, c, _zipped((x.size,), x.ravel())) for c, x in chunks if x.any()])

    return run


def totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each one's sum of n, and each input key's place among them."""
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)), inverse


def leaves(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of distinct, sorted (context, class) keys with counts: BITS + 1 numbers each, how many sightings of the context leave
    the path of the key's class at each bit, and how many are of the class itself."""
    out, before = np.zeros((len(keys), BITS + 1), "<u4"), None
    for d in range(BITS + 1 if len(keys) else 0):
        first = np.flatnonzero(np.diff(keys >> np.uint64(BITS - d), prepend=~keys[:1]))
        below = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))
        if d:
            out[:, d - 1] = np.minimum(before - below, 2**32 - 1)
        before = below
    if len(keys):
        out[:, BITS] = np.minimum(before, 2**32 - 1)
    return out


def _answer(parts_rows: list[tuple[int, int, bytes]], part: int) -> list[tuple]:
    """The sums of one range: each batch's answers, the words of each class, and the tables' chunks."""
    out, asked, tables = [], [], {}
    for kind, key, blob in parts_rows:
        raw = _unzipped(blob)
        if kind == TABLE:
            x, _ = _numbers(raw, 4, int(np.frombuffer(raw, "<u4", 1)[0]), "<u4")
            tables[key] = tables.get(key, 0) + x.astype("<u8")
            continue
        sizes, at, mine = np.frombuffer(raw, "<u4", 2), 8, []
        for m in map(int, sizes):
            steps, at = _numbers(raw, at, m, "<u8")
            n, at = _numbers(raw, at, m, "<u4")
            mine.append((np.cumsum(steps, dtype=np.uint64), n))
        asked.append((key, mine))
    for key, x in tables.items():
        out.append((part, TABLE, key, _zipped((len(x),), x)))
    if asked:
        (words, c, wi), (keys, n, ki) = (totals(*(np.concatenate([m[f][j] for _, m in asked]) for j in (0, 1))) for f in (0, 1))
        gone, known, w, k = leaves(keys, n), c > 0, 0, 0
        cls = (words[known] & np.uint64(NODES - 1)).astype(np.int64)
        out.append((part, CLASSES, part, _zipped((NODES,), np.bincount(cls, c[known], NODES).astype("<u8"), np.bincount(cls, minlength=NODES).astype("<u8"))))
        for key, mine in asked:
            a, b = (len(x[0]) for x in mine)
            path = gone[ki[k : k + b]]
            out.append((part, QUESTION, key, _zipped((a, b), c[wi[w : w + a]].astype("<u4"), *(path[:, d] for d in range(BITS + 1)))))
            w, k = w + a, k + b
    return out


def _count(batches):
    """Answers by range; rows come sorted by range."""
    part, held = None, []
    for b in batches:
        for p, kind, key, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if p != part and held:
                yield _rows(_answer(held, part))
                held = []
            part = p
            held.append((kind, key, blob))
    if held:
        yield _rows(_answer(held, part))


def _sum_classes(batches):
    import pyarrow as pa

    total = np.zeros((2, NODES), np.uint64)
    for b in batches:
        for blob in b.column(0).to_pylist():
            raw = _unzipped(blob)
            c, at = _numbers(raw, 4, NODES, "<u8")
            total += np.stack((c, _numbers(raw, at, NODES, "<u8")[0]))
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<u8").tobytes()], pa.binary())], names=["blob"])


class Model:
    """What scoring broadcasts; its size is fixed by SLOTS."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray):
        n = counts.sum(axis=1, dtype=np.float64)
        prior = (counts[:NODES, 1] + 0.4) / (n[:NODES] + 0.8)
        p = (counts[:, 1] + np.resize(prior, len(n))) / (n + 1)
        p[:NODES] = prior
        self.p, self.stretch = p.astype(np.float32), np.log(p / (1 - p)).astype(np.float32)
        self.class_whole = np.log10(classes[0] + 0.5 * (classes[1] + 1.0))


def class_bits(model: Model, t: Tokens, place: np.ndarray, gone: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 probability of the classes of each text's tokens. place: of each token among the answers (gone by bit, own).

    Texts run side by side, block by block, ``DOCS`` at once, the longest first.
    """
    sizes, total = np.diff(t.at), np.zeros(len(t.at) - 1)
    # sightings below each node of the path, after its bit
    below = (own[:, None] + np.concatenate((np.cumsum(gone[:, :0:-1], axis=1)[:, ::-1], np.zeros((len(gone), 1))), axis=1)).astype(np.float32)
    gone = gone.astype(np.float32)
    for group in np.array_split(np.argsort(-sizes, kind="stable"), max(1, -(-len(sizes) // DOCS))):
        total[group] = _group_bits(model, t, group, sizes[group], place, gone, below)
    return total


def _group_bits(model: Model, t: Tokens, group: np.ndarray, sizes: np.ndarray, place: np.ndarray, gone: np.ndarray, below: np.ndarray) -> np.ndarray:
    total, starts, end = np.zeros(len(group)), t.at[group], len(t.h) - 1
    weights = np.full((len(group), BITS, K), 1.1 / K, np.float32)
    cells = np.tile((np.arange(MAP_CELLS, dtype=np.float32) - MAP_CELLS / 2 + 0.5) * (16 / MAP_CELLS), (len(group), BITS, 1))
    cells = 1 / (1 + np.exp(-cells))
    gate = np.arange(BITS, dtype=np.int32)[None, None, :]
    for at in range(0, int(sizes[0]) if len(sizes) else 0, BLOCK):
        m = int((sizes > at).sum())
        where = np.minimum(starts[:m, None] + at + np.arange(BLOCK), end)
        there = np.arange(BLOCK)[None, :] < (sizes[:m] - at)[:, None]
        nodes, bits = nodes_and_bits(t.h[where].ravel())
        nodes, bits = nodes.reshape(m, BLOCK, BITS), bits.reshape(m, BLOCK, BITS).astype(np.float32)
        x = np.empty((K, m, BLOCK, BITS), np.float32)
        np.take(model.stretch, nodes, out=x[0])
        slot = nodes + t.slots[0][where][:, :, None]
        np.take(model.stretch, slot, out=x[1])
        for k in (2, 3):
            np.take(model.stretch, nodes + t.slots[k - 1][where][:, :, None], out=x[k])
        mine = place[where]
        off, on = gone[mine], below[mine]
        # the word before counts as one sighting of both words before
        p = np.take(model.p, slot)
        one = np.where(bits > 0, on, off)
        x[4] = np.log((one + p) / (on + off - one + (1 - p)))
        w = weights[:m]
        s = np.zeros((m, BLOCK, BITS), np.float32)
        for k in range(K):
            s += x[k] * w[:, None, :, k]
        np.clip(s, -7.9, 7.9, out=s)
        p = 1 / (1 + np.exp(-s))
        cell = ((s + 8) * (MAP_CELLS / 16)).astype(np.int32)
        flat = (np.arange(m, dtype=np.int32)[:, None, None] * BITS + gate) * MAP_CELLS + cell
        c = cells[:m].reshape(-1)
        final = np.clip(0.75 * p + 0.25 * c[flat], 1 / 4096, 1 - 1 / 4096)
        chosen = np.where(bits > 0, final, 1 - final).prod(axis=2)
        total[:m] += np.where(there, np.log10(chosen), 0).sum(axis=1)
        err = (bits - p) * there[:, :, None]
        for k in range(K):
            w[:, :, k] += RATE * (err * x[k]).sum(axis=1)
        keep = np.broadcast_to(there[:, :, None], flat.shape).ravel()
        size = m * BITS * MAP_CELLS
        seen = np.bincount(flat.ravel(), keep, size)
        gap = np.bincount(flat.ravel(), (bits - c[flat]).ravel() * keep, size)
        cells[:m] = (c + np.minimum(MAP_RATE, 0.5 / np.maximum(seen, 1)) * gap).reshape(m, BITS, MAP_CELLS)
    return total


def _read(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's answers, by range: word counts, and what leaves and ends each key's path."""
    counts, gone, own = [], [], []
    for blob in answers:
        raw = _unzipped(blob)
        a, b = map(int, np.frombuffer(raw, "<u4", 2))
        c, at = _numbers(raw, 8, a, "<u4")
        counts.append(c)
        path = np.empty((b, BITS + 1), np.uint32)
        for d in range(BITS + 1):
            path[:, d], at = _numbers(raw, at, b, "<u4")
        gone.append(path[:, :BITS])
        own.append(path[:, BITS])
    return np.concatenate(counts), np.concatenate(gone), np.concatenate(own)


_SCORED = "row long, doc_id long, whole boolean, n_bytes long, n_tokens long, n_known long, base double, score double"


def _score(shared, width: int):
    """Scores of each batch; a batch's texts (part -1) come before its answers, which come by range."""

    def score(texts: bytes, answers: list[bytes]):
        import pyarrow as pa

        model, docs = shared.value, _unpacked(texts)
        t = Tokens(docs["text"], docs["skip"], docs["last"], width)
        counts, gone, own = _read(answers)
        c = counts[np.unique(t.h, return_inverse=True)[1]]
        bits = class_bits(model, t, np.unique(t.keys, return_inverse=True)[1], gone, own)
        log = np.log10(c + 0.5)
        by_text = lambda x: np.add.reduceat(np.append(x, 0), t.at[:-1]) * (np.diff(t.at) > 0)
        within = by_text(log - model.class_whole[(t.h & np.uint64(NODES - 1)).astype(np.int64)])
        whole = [a and s == 0 for a, s in zip(docs["last"], docs["skip"], strict=True)]
        cols = (docs["row"], docs["doc_id"], whole, docs["bytes"], np.diff(t.at), by_text((c > 0).astype(np.int64)), by_text(log), within + bits)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["row", "doc_id", "whole", "n_bytes", "n_tokens", "n_known", "base", "score"])

    def run(batches):
        texts, answers = None, []
        for b in batches:
            for part, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part >= 0:
                    answers.append(blob)
                    continue
                if texts is not None:
                    yield score(texts, answers)
                texts, answers = blob, []
        if texts is not None:
            yield score(texts, answers)

    return run


def score(docs: DataFrame, teach: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of docs, learned from those where teach is true."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), teach.alias("teach"))
    batches = stored(rows.mapInArrow(tidied(_batched), "batch long, bytes long, blob binary"), "batches")
    size = batches.agg(F.sum("bytes")).first()[0] or 0
    width, parts = min(56, max(32, size.bit_length() + 7)), -(-size // RANGE) or 1
    asked = batches.select("batch", "blob").mapInArrow(tidied(_ask(width, parts)), _SHAPE)
    dealt = asked.repartition(parts, "part").sortWithinPartitions("part", "kind", "key")
    got = stored(dealt.mapInArrow(tidied(_count), _SHAPE), "counted")
    classes = np.zeros((2, NODES), np.uint64)
    for r in got.where(F.col("kind") == CLASSES).select("blob").mapInArrow(_sum_classes, "blob binary").toLocalIterator():
        classes += np.frombuffer(r["blob"], "<u8").reshape(2, NODES)
    counts = np.zeros((-(-SLOTS // CHUNK) * CHUNK, 2), np.uint64)
    for r in got.where(F.col("kind") == TABLE).select("key", "blob").toLocalIterator():  # a fixed number of chunks
        raw = _unzipped(r["blob"])
        x, _ = _numbers(raw, 4, int(np.frombuffer(raw, "<u4", 1)[0]), "<u8")
        counts[r["key"] * CHUNK :][: len(x) // 2] = x.reshape(-1, 2)
    shared = spark.sparkContext.broadcast(Model(counts[:SLOTS], classes))
    both = batches.select(F.col("batch").alias("key"), F.lit(-1).alias("part"), "blob").unionByName(got.where(F.col("kind") == QUESTION).select("key", "part", "blob"))
    dealt = both.repartition(max(1, -(-size // (2 * BATCH))), "key").sortWithinPartitions("key", "part")
    part = stored(dealt.mapInArrow(tidied(_score(shared, width)), _SCORED), "scored")
    sums = ["n_bytes", "n_tokens", "n_known", "base", "score"]
    # only texts in several pieces are summed
    out = part.where("whole").select("doc_id", *sums).unionByName(part.where("not whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in sums)).drop("row"))
    known, kinds = int(classes[0].sum()), int(classes[1].sum())
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(known).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(known + 0.5 * (kinds + 1)))).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def training_rows(id_col: str = "doc_id") -> Column:
    return crc(id_col) % 5 != 1


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that aren't held out."""
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), training_rows())
    return out.withColumn("held_out", crc("doc_id") % 5 == 1)
