"""Near-duplicate removal with HyperMinHash.

A document's set is its distinct five-word shingles. Its sketch has ``BUCKETS`` registers: a shingle's hash picks the
bucket, and the smallest remaining hash there is stored as its count of leading zeros and the ``MANTISSA`` bits after
them, 16 bits in all. An empty bucket takes the register of a bucket that a fixed permutation names.

Equal sets are one class from the start, by a digest of the whole set: only one member of each has a sketch that moves
on. Registers are banded, six to a band. Of a band's bucket a pivot stands against all other members; those pairs are
linear in the bucket's size, whatever that is. A pair whose Jaccard estimate, corrected for registers that agree by
chance, lies six standard errors under the threshold goes; the rest is confirmed on the full sets. Confirmed links
join components, and a bucket whose members are all in one is done. In the other buckets members of different
components are compared block by block, first by sketch; those of a likely pair come back with their texts and are
confirmed on the full sets until links join their components. So no pair that shares a band is lost, whatever the
bucket's size, and only links leave a group, fewer than its members. A pair shares a band but for a chance of
6e-5 at a similarity of 0.80, 3e-7 at 0.85 and 1e-14 at 0.92; the estimate loses fewer than 3e-7 of pairs at the threshold.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are kept; rows that share a doc_id
are one node; rows with a null doc_id get a null component, are kept, and link nothing; an empty table gives no rows;
texts are read whole at any length. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.graph import components

from .common import maybe_broadcast, stored, table, tidied
from .shingles import shingle_sets

BUCKETS, ROWS, MANTISSA = 192, 6, 10
BANDS = BUCKETS // ROWS
PERCENT = 80
#: The registers that are kept for estimates: every second one.
KEPT = BUCKETS // 2
BLOCK = 2048
_ORDER = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)
_BAND = np.random.default_rng(11).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted, non-empty array of 64-bit hashes."""
    bucket = ((s >> np.uint64(52)) * np.uint64(BUCKETS)) >> np.uint64(12)
    first = np.searchsorted(bucket, np.arange(BUCKETS, dtype=np.uint64))
    have = np.zeros(BUCKETS, bool)
    inside = first < len(s)
    have[inside] = bucket[first[inside]] == np.flatnonzero(inside)
    reg = np.zeros(BUCKETS, np.uint16)
    starts = first[have]
    rest = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(10)  # 54 bits
    low = np.minimum.reduceat(rest, starts).astype(np.float64) + 0.5
    mant, exp = np.frexp(low)
    reg[have] = ((54 - np.clip(exp, 0, 54)) << MANTISSA) | ((mant * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    if not have.all():
        empty = np.flatnonzero(~have)
        source = _ORDER[empty]
        reg[empty] = reg[source[np.arange(len(empty)), have[source].argmax(axis=1)]]
    return reg


def band_keys(reg: np.ndarray) -> np.ndarray:
    r = (reg.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _BAND
    k = r.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(29)
    return (k * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


#: Chance that registers of two different minima agree: about a third for the zeros, 2**-MANTISSA for the rest.
COLLISION = 1 / 3 / (1 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, corrected for chance agreement."""
    return (equal - COLLISION) / (1 - COLLISION)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - 6 * (j * (1 - j) / KEPT) ** 0.5


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, digest, bands array<long>, kept binary): one row per document; the last three are null for empty sets."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            rows = []
            for s in shingle_sets(b.column(1).to_pylist()):
                if len(s):
                    reg = registers(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(reg).tolist(), reg[::2].tobytes()))
                else:
                    rows.append((0, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "digest", "bands", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n long, digest binary, bands array<long>, kept binary")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked: the Jaccard similarity of the full shingle sets reaches the threshold."""
    one = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            linked = [_linked(s, t, percent) for s, t in zip(*(shingle_sets(batch.column(k).to_pylist()) for k in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    rows = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(tidied(run), "a long, b long, linked boolean")


def _groups(batches, keys: int):
    """Column lists of each run of rows with the same first columns; the input is sorted by these."""
    key, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[:keys] != key:
                if rows:
                    yield list(zip(*rows, strict=True))
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield list(zip(*rows, strict=True))


def _likely(side, comps, ns, regs, bands, band, least: float, percent: int) -> list[tuple[float, int, int]]:
    """(estimate, i, j) of members in different components that may be a link and share no earlier band."""
    side, comps, ns = np.array(side), np.array(comps), np.array(ns)
    regs = np.frombuffer(b"".join(regs), np.uint16).reshape(len(ns), KEPT)
    bands = np.array(bands, dtype=np.int64)
    right = np.flatnonzero(side != 1)
    found = []
    for i in np.flatnonzero(side != 2):
        js = right[(comps[right] != comps[i]) & (100 * np.minimum(ns[right], ns[i]) >= percent * np.maximum(ns[right], ns[i]))]
        if side[i] == 0:
            js = js[js > i]
        if len(js):
            est = estimate((regs[js] == regs[i]).mean(axis=1))
            good = est >= least
            js, est = js[good], est[good]
            if len(js) and band:
                new = ~(bands[js, :band] == bands[i, :band]).any(axis=1)
                js, est = js[new], est[new]
            found += zip(est.tolist(), [int(i)] * len(js), js.tolist(), strict=True)
    return found


def _in_question(least: float, percent: int):
    """Of each block pair, the members of a likely pair. Input: key, x, y, band, side, id, component, n, kept, bands."""

    def run(batches):
        import pyarrow as pa

        for key, x, y, band, side, id_, comps, ns, regs, bands in _groups(batches, 3):
            some = sorted({k for _, i, j in _likely(side, comps, ns, regs, bands, band[0], least, percent) for k in (i, j)})
            cols = [[c[k] for k in some] for c in (key, x, y, band, side, id_, comps, ns, regs, bands)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "x", "y", "band", "side", "id", "component", "n", "kept", "bands"])

    return run


def _links(least: float, percent: int):
    """Of each block pair, links that join its components, confirmed on the full sets, likeliest first.

    A pair is passed over only if links already join its two components. Input as before, then text.
    """

    def run(batches):
        import pyarrow as pa

        for _, _, _, band, side, id_, comps, ns, regs, bands, text in _groups(batches, 3):
            parent: dict[int, int] = {c: c for c in comps}
            sets: dict[int, np.ndarray] = {}

            def root(c: int, parent=parent) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            def full(k: int, sets=sets, text=text) -> np.ndarray:
                if k not in sets:
                    sets[k] = next(shingle_sets([text[k]]))
                return sets[k]

            out = []
            for _, i, j in sorted(_likely(side, comps, ns, regs, bands, band[0], least, percent), reverse=True):
                if root(comps[i]) != root(comps[j]) and _linked(full(i), full(j), percent):
                    parent[root(comps[i])] = root(comps[j])
                    out.append((id_[i], id_[j]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((s, t)), kind="stable")
    both = int((both[1:] == both[:-1]).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents are linked where 100 * intersection >= percent * union. Each component keeps its smallest doc_id.
    """
    spark, least = docs.sparkSession, least_estimate(percent)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_ = stored(sketches(docs, id_col, text_col), "sketches")
    # one member of each class of equal sets; partial minima leave one row per class and task
    reps = all_.where(F.col("n") > 0).where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands", "kept")).alias("r"))
    reps = stored(reps.select("digest", F.col("r.doc_id").alias("id"), "r.n", "r.bands", "r.kept"), "classes")
    keys = reps.select("id", F.posexplode("bands").alias("band", "key"))
    # a pivot by hash differs from band to band, so a class meets many members of a large group
    shared = stored(keys.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("pivot"), F.count("*").alias("m")).where("m > 1"), "buckets")  # equal keys are of one band
    members = stored(keys.join(shared.hint("merge"), "key").select("key", "band", "id", "pivot", "m"), "members")
    sides = reps.select("id", "n", "kept")
    wide = reps.select("id", "n", "kept", "bands")
    pairs = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    near = pairs.join(sides.toDF("a", "na", "ka"), "a").join(sides.toDF("b", "nb", "kb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, KEPT) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(estimate((x == y).mean(axis=1)), pa.float64())], names=["a", "b", "est"])

    todo = stored(near.select("a", "b", "ka", "kb").mapInArrow(tidied(judge), "a long, b long, est double").where(F.col("est") >= least), "pairs")
    # the texts that can be in any link; later rounds read only these
    wanted = members.select("id").distinct()
    texts = stored(plain.join(wanted.hint("merge"), "id", "left_semi"), "texts")
    state = {"labels": spark.createDataFrame([], "id long, component long")}

    def labelled(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(state["labels"].select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"c_{c}", F.coalesce(f"_{c}", c)).drop(f"_{c}")
        return df

    def join_links(links: DataFrame) -> None:
        """Join the components that links meet."""
        step = components(labelled(links, "a", "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).toDF("component", "joined")
        old = state["labels"]
        moved = old.join(step, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
        added = step.toDF("id", "component").join(old.select("id"), "id", "left_anti")
        state["labels"] = stored(moved.unionAll(added), "labels")

    def confirm(some: DataFrame) -> None:
        join_links(stored(_confirm(some, texts, percent).where("linked").select("a", "b"), "confirmed"))

    # first each class's likeliest pivot, then what pivots could still join two components
    confirm(todo.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"))
    rest = labelled(todo, "a", "b").where("c_a <> c_b")
    confirm(rest.groupBy("c_a", "b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"))
    # what is left: buckets whose members are in several components, cut into blocks; every two blocks meet in one group
    lab = labelled(members.select("key", "band", "id", "m"), "id").withColumnRenamed("c_id", "component")
    mixed = stored(lab.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")
    rows = lab.join(mixed.hint("merge"), "key", "left_semi").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    rows = rows.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.col("band"), side.alias("side"), "id", "component")
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    shape = "key long, x int, y int, band int, side int, id long, component long, n long, kept binary, bands array<long>"
    asked = stored(together(rows.join(wide, "id").select("key", "x", "y", "band", "side", "id", "component", "n", "kept", "bands")).mapInArrow(tidied(_in_question(least, percent)), shape), "asked")
    links = together(asked.join(texts, "id").select(*asked.columns, "text")).mapInArrow(tidied(_links(least, percent)), "a long, b long")
    join_links(stored(links.distinct(), "links"))
    classes = reps.select("digest", "id").join(state["labels"], "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    classes = stored(classes, "components")
    out = all_.select("doc_id", "n", "digest").join(classes.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates; columns as before."""
    gone = stored(near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "duplicates")
    # repeats of a kept doc_id stand for the same document
    return docs.join(maybe_broadcast(gone, gone.count()), id_col, "left_anti")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
