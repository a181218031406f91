"""Robust statistics, out-of-class distance, neighbours and tile anomalies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions.grading import bounded
from attestry.functions.vectors import as_doubles
from attestry.session import stored

MAD_SCALE = 1.4826


#: Groups of up to so many rows are ordered in one task, after a count of the largest; larger ones are cut first. The result is the same.
SMALL = 1_000_000


def _small(df: DataFrame, by: list[str]) -> bool:
    return (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= SMALL


def medians(df: DataFrame, by: list[str], value: Column, name: str = "median") -> DataFrame:
    """(*by, name): the exact median of each group.

    In groups over ``SMALL`` a sketch brackets it between two values that a thousandth of the group's rows lie between, give or take ties. Rows below are counted, and only
    the distinct values inside are ordered: no task holds a group's values.
    """
    d = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    if _small(df, by):
        return d.groupBy(*by).agg(F.percentile("_v", 0.5).alias(name))
    cut = d.groupBy(*by).agg(F.percentile_approx("_v", [0.4995, 0.5005], 100_000).alias("_c"), F.count("*").alias("_n"))
    near = d.join(cut, by)
    lo, hi = F.col("_c")[0], F.col("_c")[1]
    below = near.where(F.col("_v") < lo).groupBy(*by).agg(F.count("*").alias("_below"))
    c = near.where((F.col("_v") >= lo) & (F.col("_v") <= hi)).groupBy(*by, "_v").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = F.sum("_k").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    r = c.join(below, by, "left").withColumn("_upto", F.coalesce("_below", F.lit(0)) + upto)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    return r.groupBy(*by).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))


def robust_z(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with z: distance from the group's median in scaled MADs; population deviation where the MAD is 0, else 1."""
    med = df.groupBy(by).agg(F.stddev_pop(value).alias("_sd")).join(medians(df, [by], F.col(value), "_med"), by)
    d = df.join(med, by)
    mad = medians(d, [by], F.abs(F.col(value) - F.col("_med")), "_mad").withColumn("_mad", F.col("_mad") * MAD_SCALE)
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return d.join(mad, by).withColumn("z", (F.col(value) - F.col("_med")) / scale).drop("_med", "_sd", "_mad")


def mad_index(df: DataFrame, value: str) -> DataFrame:
    """df with index: how far below the median a value lies, in scaled MADs; the population deviation where that is 0, else 1."""
    one = df.withColumn("_one", F.lit(1))
    med = medians(one, ["_one"], F.col(value), "_med").drop("_one").crossJoin(df.agg(F.stddev_pop(value).alias("_sd")))
    d = df.crossJoin(F.broadcast(med))  # one row
    mad = medians(d.withColumn("_one", F.lit(1)), ["_one"], F.abs(F.col(value) - F.col("_med")), "_mad").drop("_one")
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad") * MAD_SCALE).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return d.crossJoin(F.broadcast(mad)).withColumn("index", (F.col("_med") - F.col(value)) / scale).drop("_med", "_sd", "_mad")


def nearest_in_class(df: DataFrame, label: str, distance: str, key: str, k: Column) -> DataFrame:
    """The first k (a column of the class) rows of each class by (distance, key).

    In classes over ``SMALL`` a sketch cuts the distances: rows clearly within the first k are counted, not ordered, rows clearly beyond are left, and only
    those between are ranked.
    """
    d = df.withColumn("_k", k.cast("long"))
    r = F.row_number().over(W.partitionBy(label).orderBy(distance, key))
    if _small(df, [label]):
        return d.withColumn("_r", r).where("_r <= _k").select(df.columns)
    share = d.groupBy(label).agg(F.percentile_approx(distance, [i / 200 for i in range(201)], 20_000).alias("_q"), F.count("*").alias("_n"))
    d = d.join(share, label)
    # two cuts, half a hundredth of the class to each side of the one that holds rank k
    place = F.floor(200 * F.col("_k") / F.col("_n")).cast("int")
    lo, hi = F.get("_q", F.greatest(F.lit(0), place - 2)), F.get("_q", F.least(F.lit(200), place + 2))
    d = d.withColumns({"_lo": F.when(place > 2, lo).otherwise(float("-inf")), "_hi": F.when(place < 198, hi).otherwise(float("inf"))}).drop("_q", "_n")
    sure = d.where(F.col(distance) < F.col("_lo"))
    taken = sure.groupBy(label).agg(F.count("*").alias("_sure"))
    edge = d.where((F.col(distance) >= F.col("_lo")) & (F.col(distance) <= F.col("_hi"))).join(taken, label, "left")
    edge = edge.withColumn("_r", r).where(F.col("_r") <= F.col("_k") - F.coalesce("_sure", F.lit(0)))
    return sure.select(df.columns).unionByName(edge.select(df.columns))


def class_distances(samples: DataFrame, id_col: str, label: str, vector: str, least: int = 8, share: float = 0.7) -> DataFrame:
    """(id, label, distance, ratio, score) from each class's trimmed centre; classes under ``least`` are left out.

    The centre starts at the coordinate medians and twice moves to the mean of the nearest max(4, int(share n)).
    """
    s = samples.select(F.col(id_col).alias("id"), F.col(label).alias("label"), as_doubles(F.col(vector)).alias("v"))
    n = s.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    s = s.join(n, "label")
    long = s.select("id", "label", F.posexplode("v").alias("at", "x"))
    centre = stored(medians(long, ["label", "at"], F.col("x"), "c"), "centre")
    core = None
    for _ in range(2):
        # the centre is one vector per class: it joins whole, and rows aren't exploded again
        whole = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("centre"))
        d = s.join(whole, "label").withColumn("d", F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)))
        # each pass is stored: the next reads it several times
        core = stored(nearest_in_class(stored(d.drop("centre"), "distances"), "label", "d", "id", F.greatest(F.lit(4), F.floor(F.col("n") * share))), "core")
        centre = core.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("c"))
    whole = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("centre"))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    out = stored(s.join(whole, "label").select("id", "label", distance.alias("distance")), "distances")
    typical = medians(out.join(core.select("id"), "id", "left_semi"), ["label"], F.col("distance"), "t")
    out = out.join(typical, "label").withColumn("ratio", F.col("distance") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))
    return out.select("id", "label", "distance", "ratio", bounded(F.col("ratio"), 2.0, 3.0).alias("score"))


#: Blocks into which samples are cut, so that there is work for all tasks; more where one would hold over BLOCK_MB.
PARTS, BLOCK_MB = 8, 64


def _vectors(df: DataFrame, id_col: str, vector: str, least: int) -> tuple[DataFrame, int, int]:
    """(id, u, mine): vectors as they are, with the block of each, the number of blocks and that of components. Doubles are made in the task that needs them."""
    v = df.select(F.col(id_col).alias("id"), F.col(vector).alias("u")).where("id is not null")
    n, width = v.agg(F.count("*"), F.greatest(F.coalesce(F.max(F.size("u")), F.lit(1)), F.lit(1))).first()
    blocks = max(least, math.ceil(n * width * 8 / (BLOCK_MB * 1e6)))
    return v.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks, width


def _matrix(table, width: int):
    """(ids, rows of length 1, which of them have no vector): those that have none are zero, as are those with a component that isn't finite, which are NaN in the third."""
    import numpy as np

    lists = table["u"].combine_chunks()
    flat, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    gone = np.bincount(np.repeat(np.arange(len(lengths)), lengths), np.asarray(flat.is_null(), float), len(lengths)) > 0
    full = lengths == width
    u = np.zeros((len(lengths), width))
    u[full] = flat.to_numpy(zero_copy_only=False).astype(float)[np.repeat(full, lengths)].reshape(int(full.sum()), width)
    with np.errstate(all="ignore"):
        u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None] + 1e-12
    bad = np.where(np.isfinite(u).all(axis=1), 0.0, np.nan)
    bad[~full | gone] = -np.inf
    u[bad != 0] = 0
    return table["id"].combine_chunks(), u, bad


def _best(asks, gives, k: int, rows: int = 256, columns: int = 8192):
    """Record batches (id, other, similarity) of each asking row's k best others; of equal ones those with the smaller id.

    Products of single precision leave out what is clearly not among the best; the rest, ties and all that lie within their error, is computed in doubles.
    """
    import numpy as np
    import pyarrow as pa

    (ids, q, bad), (others, o, worse) = asks, gives
    if not len(q) or not len(o):
        return
    _, codes = np.unique(np.concatenate([ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)]), return_inverse=True)
    mine, code = codes[: len(q)], codes[len(q) :]
    least = k + int(np.bincount(code).max())  # the row itself, as often as it is there, isn't its neighbour
    margin = np.float32(4e-7 * (q.shape[1] + 8))
    q32, o32, odd = q.astype(np.float32), np.ascontiguousarray(o.astype(np.float32).T), np.flatnonzero(worse)
    for i in range(0, len(q), rows):
        part, at, floor, found = q32[i : i + rows], np.arange(len(q[i : i + rows])), None, []
        for j in range(0, len(o), columns):
            s = part @ o32[:, j : j + columns]
            if floor is None:
                floor = np.partition(s, -least, axis=1)[:, -least] - margin if s.shape[1] > least else np.full(len(part), -np.inf, np.float32)
                # rows and others without a finite vector meet all: they are few
                floor[bad[i : i + rows] != 0] = -np.inf
            r, c = np.nonzero(s >= floor[:, None])
            found.append((r, c + j))
        r, c = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(odd):
            r, c = np.divmod(np.unique(np.concatenate([r * len(o) + c, (at[:, None] * len(o) + odd[None, :]).ravel()])), len(o))
        keep = mine[i + r] != code[c]
        r, c = r[keep], c[keep]
        s = np.round(np.einsum("ij,ij->i", q[i + r], o[c]), 9) + bad[i + r] + worse[c]
        s[(bad[i + r] == -np.inf) | (worse[c] == -np.inf)] = -np.inf
        order = np.lexsort((code[c], np.where(np.isnan(s), -np.inf, -s), r))
        r, c, s = r[order], c[order], s[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, s = r[top], c[top], s[top]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + r)), others.take(pa.array(c)), pa.array(s, mask=s == -np.inf)], ["id", "other", "similarity"])


def _ranked(pairs: DataFrame, tasks: int, width: int, k: int, both: bool) -> DataFrame:
    """(id, other, similarity, rank) of (task, side, id, u): side 0 asks and side 1 gives, or both do both; without a side 1 the rows of side 0 meet each other."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        some = [b for b in batches if b.num_rows]
        if not some:
            return
        t = pa.Table.from_batches(some)
        one, two = (_matrix(t.filter(pa.compute.equal(t["side"], side)), width) for side in (0, 1))
        if not both:
            yield from _best(one, two, k)
        elif not len(two[1]):
            yield from _best(one, one, k)
        else:
            yield from _best(one, two, k)
            yield from _best(two, one, k)

    # a task for each two blocks, whatever their size in bytes: it is the work that counts
    some = pairs.repartitionById(tasks, "task").select("side", "id", "u").mapInArrow(run, f"id {kind}, other {kind}, similarity double")
    r = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return some.withColumn("rank", r).where(F.col("rank") <= k)


def nearest(queries: DataFrame, samples: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, other, similarity, rank): each query's k nearest samples by cosine, itself excluded.

    Blocks of queries meet blocks of samples in matrix products, a task for each two; a task passes on at most k for each query, and nothing is broadcast.
    """
    (q, m, wide), (s, n, width) = _vectors(queries, id_col, vector, 1), _vectors(samples, id_col, vector, 4 * PARTS)
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("there")
    asks = q.select("id", "u", "mine", all_of(n)).select((F.col("mine") * n + F.col("there")).alias("task"), F.lit(0).alias("side"), "id", "u")
    gives = s.select("id", "u", "mine", all_of(m)).select((F.col("there") * n + F.col("mine")).alias("task"), F.lit(1).alias("side"), "id", "u")
    return _ranked(asks.unionByName(gives), m * n, max(wide, width), k, both=False)


def nearest_blocks(samples: DataFrame, id_col: str, vector: str, k: int, rows: int | None = None) -> DataFrame:
    """(id, other, similarity, rank): each sample's k nearest others by cosine, exactly, in matrix products of blocks.

    Every two blocks meet in one task, which passes on at most k for each sample; no side is broadcast. All pairs are compared, as the result asks
    for. What is shuffled is the table and its neighbours once for each block; blocks are eight, so that it grows as the table does, until one holds ``BLOCK_MB``.
    ``rows`` asks for blocks of so many rows instead.
    """
    s, n, width = _vectors(samples, id_col, vector, PARTS if rows is None else max(1, -(-samples.count() // rows)))
    s = s.select("id", "u", "mine", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    x, y = F.least("mine", "other"), F.greatest("mine", "other")
    # the pairs x <= y are numbered one by one
    task = (y * (y + 1) / 2).cast("int") + x
    return _ranked(s.select(task.alias("task"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "u"), n * (n + 1) // 2, width, k, both=True)


def mean_distance(queries: DataFrame, samples: DataFrame, id_col: str, label: str, vector: str, k: int = 5) -> DataFrame:
    """(id, distance): each query's mean distance to the k nearest samples of its own class.

    A query meets its class only; of each task's share at most k a query are shuffled on, by a partial top k.
    """
    v = lambda df, i, x: df.select(F.col(id_col).alias(i), F.col(label).alias("label"), as_doubles(F.col(vector)).alias(x))
    apart = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    pairs = v(samples, "other", "w").join(v(queries, "id", "v"), "label").where("id <> other").select("id", "other", apart.alias("d"))
    r = F.row_number().over(W.partitionBy("id").orderBy("d", "other"))
    return pairs.withColumn("r", r).where(F.col("r") <= k).groupBy("id").agg(F.avg("d").alias("distance"))


def label_disagreement(near: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, label, majority, agreement, score): (1 - agreement) times the majority's share; on a tie the nearest wins."""
    one = labels.select(F.col("id").alias("other"), F.col("label").alias("l"))
    n = near.join(one, "other").groupBy("id", "l").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    top = n.groupBy("id").agg(F.max(F.struct("n", -F.col("r"), "l")).alias("m"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by"))
    out = top.join(labels, "id").select("id", "label", F.col("m.l").alias("majority"), (F.coalesce(F.element_at("by", F.col("label")), F.lit(0)) / k).alias("agreement"), (F.col("m.n") / k).alias("coherence"))
    return out.select("id", "label", "majority", "agreement", ((1 - F.col("agreement")) * F.col("coherence")).alias("score"))


def tile_anomaly(samples: DataFrame, id_col: str, vector: str, hot: float = 4.0) -> DataFrame:
    """(id, worst_tile, worst_z, hot, consistency) against the same tile of all samples; of equal tiles the first."""
    t = samples.select(F.col(id_col).alias("id"), F.posexplode(as_doubles(F.col(vector))).alias("tile", "x"))
    med = medians(t, ["tile"], F.col("x"), "m")
    d = t.join(F.broadcast(med), "tile").withColumn("d", F.abs(F.col("x") - F.col("m")))
    mad = medians(d, ["tile"], F.col("d"), "mad")
    z = d.join(F.broadcast(mad), "tile").select("id", "tile", (F.col("d") / (MAD_SCALE * F.col("mad") + 1e-9)).alias("z"))
    rate = z.groupBy("tile").agg(F.avg((F.col("z") > hot).cast("double")).alias("hot_rate"))
    worst = z.groupBy("id").agg(F.max(F.struct("z", -F.col("tile"))).alias("w")).select("id", (-F.col("w.col2")).alias("tile"), F.col("w.z").alias("worst_z"))
    return worst.join(F.broadcast(rate), "tile").select("id", F.col("tile").alias("worst_tile"), "worst_z", (F.col("worst_z") > hot).alias("hot"), F.when(F.col("worst_z") > hot, F.col("hot_rate")).otherwise(0.0).alias("consistency"))
