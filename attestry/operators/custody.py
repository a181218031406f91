"""Signed logs: signing, signature and handoff checks, one headline failure a record, and faults to test them with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from attestry.functions import canonical, ed25519
from attestry.operators import logs
from attestry.session import stored

SIGNATURE, ACTOR, HANDOFF = "SIGNATURE_INVALID", "UNKNOWN_ACTOR", "HANDOFF_MISMATCH"
HOP_REPLAY, HOP_GAP = "HOP_REPLAY", "HOP_GAP"
# Fixed values of the output contract: the earliest of these names a record with several failures.
PRIORITY = (logs.MALFORMED, logs.REPLAY, logs.NONCE, logs.GAP, SIGNATURE, logs.TIME, logs.CHAIN)
HOP_PRIORITY = (logs.MALFORMED, ACTOR, HOP_REPLAY, HOP_GAP, SIGNATURE, HANDOFF, logs.TIME, logs.CHAIN)
#: What a hop must have.
HOP_FIELDS = ("seq", "actor_id", "input_digest", "output_digest", "prev_hash", "record_hash", "ts", "signature")


def signed(records: DataFrame, message: str, seed: str, to: str = "signature") -> DataFrame:
    """records with the Ed25519 signature (binary) of a text column under a seed column (32 bytes)."""
    @pandas_udf("binary")
    def run(m: pd.Series, s: pd.Series) -> pd.Series:
        ok = [i for i, (x, y) in enumerate(zip(m, s, strict=True)) if x is not None and y is not None]
        out = [None] * len(m)
        for i, x in zip(ok, ed25519.sign_all([bytes(s.iloc[i]) for i in ok], [m.iloc[i].encode() for i in ok]), strict=True):
            out[i] = x
        return pd.Series(out, dtype=object)

    return records.withColumn(to, run(message, seed))


def signature_failures(records: DataFrame, keyring: DataFrame, message: str = "record_hash", actor: str = "actor_id") -> DataFrame:
    """(chain, idx, seq, code) of records whose actor has no key or whose signature is wrong or missing. keyring: (actor, key binary)."""
    @pandas_udf("boolean")
    def good(k: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        rows = [(i, bytes(a), b.encode(), bytes(c)) for i, (a, b, c) in enumerate(zip(k, m, s, strict=True)) if a is not None and b is not None and c is not None]
        out = [False] * len(k)
        for (i, *_), x in zip(rows, ed25519.verify_all(*([r[j] for r in rows] for j in (1, 2, 3))), strict=True):
            out[i] = x
        return pd.Series(out, dtype=bool)

    known = records.join(keyring.select(actor, F.col("key").alias("_key")).dropDuplicates([actor]), actor, "left")
    code = F.when(F.col("_key").isNull(), ACTOR).when(~F.col("_good"), SIGNATURE)
    return known.withColumn("_good", good("_key", message, "signature")).select("chain", "idx", "seq", code.alias("code")).where("code is not null")


def verify_receipts(log: DataFrame, keyring: DataFrame, message: str = "record_hash", actor: str = "actor_id", content_hash: Column | None = None) -> DataFrame:
    """(chain, idx, seq, code) with all seven codes of a signed log: those of its order, and SIGNATURE_INVALID for a well-formed
    record whose signature isn't its signer's, also where no key is known."""
    ok = logs.well_formed()
    signed_ = signature_failures(log.where(ok), keyring, message, actor).withColumn("code", F.lit(SIGNATURE))
    return logs.verify_log(log, content_hash).unionByName(signed_)


def verify_custody(hops: DataFrame, keyring: DataFrame, message: str = "record_hash", actor: str = "actor_id", content_hash: Column | None = None) -> DataFrame:
    """(chain, idx, seq, code) with all eight codes of a custody chain. hops: chain, idx (the line), seq (the hop's number),
    actor, input_digest, output_digest, prev_hash, record_hash, ts, signature.

    A malformed hop (a null in any of ``HOP_FIELDS``) is reported and otherwise passed over: the next good hop follows the last good one.
    The hops are stored first: every check reads them, and what makes them, signatures for one, may be dear.
    """
    needed = ["chain", "idx", *(c if c != "actor_id" else actor for c in HOP_FIELDS), message]
    if content_hash is not None:
        hops, content_hash = hops.withColumn("_content", content_hash), F.col("_content")
        needed.append("_content")
    hops = hops.select(*dict.fromkeys(needed))
    hops = stored(hops.withColumns({c: F.col(c).cast("string") for c, kind in hops.dtypes if kind == "void"}), "hops")
    ok = F.lit(True)
    for c in HOP_FIELDS:
        ok = ok & F.col(c if c != "actor_id" else actor).isNotNull()
    bad = hops.where(~ok).select("chain", "idx", "seq", F.lit(logs.MALFORMED).alias("code"))
    good = hops.where(ok)
    # nonces aren't part of a hop: each line gets one of its own
    order = logs.verify_log(good.withColumn("nonce", F.col("idx").cast("string")), content_hash)
    named = F.when(F.col("code") == logs.REPLAY, HOP_REPLAY).when(F.col("code") == logs.GAP, HOP_GAP).otherwise(F.col("code"))
    hand = logs.verify_handoffs(good.withColumn("hop", F.col("idx"))).withColumnRenamed("hop", "idx").join(good.select("chain", "idx", "seq"), ["chain", "idx"])
    return bad.unionByName(order.withColumn("code", named)).unionByName(signature_failures(good, keyring, message, actor)).unionByName(hand.select("chain", "idx", "seq", F.lit(HANDOFF).alias("code")))


def content_digest(samples: DataFrame, key: str = "sample_id", digest: str = "sha256", label: str | None = None) -> DataFrame:
    """(digest, n): one digest of a data set's (id, content digest, label) rows, whatever their order.

    Rows are hashed by id range first, and the ranges' digests, in order, once more: no task sees more than a range.
    """
    from attestry.operators.ordered import RANGES

    rows = samples.select(F.col(key).cast("string").alias("k"), F.to_json(F.array(F.col(key).cast("string"), F.col(digest).cast("string"), (F.col(label) if label else F.lit(None)).cast("string"))).alias("r"))
    # the first byte of an id's hash names its range: the same for any table that holds the id
    part = F.conv(F.substr(F.sha2("k", 256), F.lit(1), F.lit(2)), 16, 10).cast("int") % RANGES
    parts = rows.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["d"])), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def add_hop(hops: DataFrame, chain: str, actor: str, seed: bytes, output_digest: str, ts: str, stage: str = "", description: str = "") -> DataFrame:
    """hops (chain, idx, seq, stage, actor_id, input_digest, output_digest, description, ts, prev_hash, record_hash, signature) of
    one chain with another at its end, which takes up what the last one put out. Only the chain's last hop is read."""
    last = hops.where(F.col("chain") == chain).agg(F.max_by(F.struct("idx", "seq", "record_hash", "output_digest"), "idx").alias("l")).first()["l"]
    new = {
        "chain": chain, "idx": last["idx"] + 1 if last else 0, "seq": last["seq"] + 1 if last else 0, "stage": stage, "actor_id": actor,
        "input_digest": last["output_digest"] if last else logs.GENESIS, "output_digest": output_digest, "description": description, "ts": ts,
        "prev_hash": last["record_hash"] if last else logs.GENESIS,
    }
    new["record_hash"] = canonical.digest(new)
    new["signature"] = bytearray(ed25519.sign(seed, new["record_hash"].encode()))
    one = hops.sparkSession.createDataFrame([tuple(new[c] for c in HOP_COLUMNS)], HOPS)
    return hops.select(*HOP_COLUMNS).unionByName(one)


HOPS = "chain string, idx long, seq long, stage string, actor_id string, input_digest string, output_digest string, description string, ts string, prev_hash string, record_hash string, signature binary"
HOP_COLUMNS = [c.split()[0] for c in HOPS.split(", ")]


def headlines(failures: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """(chain, seq, idx, code, codes): failures of one record number together under the gravest code; without a number, by line."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("code"))
    key = F.when(F.col("seq").isNull(), F.col("idx"))
    g = failures.groupBy("chain", "seq", key.alias("_line")).agg(F.min("idx").alias("idx"), F.min_by("code", rank).alias("code"), F.array_sort(F.collect_set("code")).alias("codes"))
    return g.drop("_line")


def alter(log: DataFrame, idx: int, **values) -> DataFrame:
    """log with one line's fields replaced, as an intruder would who can't sign."""
    return log.withColumns({c: F.when(F.col("idx") == idx, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def alter_where(log: DataFrame, rows: Column, **values: Column) -> DataFrame:
    return log.withColumns({c: F.when(rows, v).otherwise(F.col(c)) for c, v in values.items()})


def replay(log: DataFrame, idx: int, after: int) -> DataFrame:
    """log with one line's copy put in after another; later lines move down by one."""
    moved = log.withColumn("idx", F.when(F.col("idx") > after, F.col("idx") + 1).otherwise(F.col("idx")))
    return moved.unionByName(log.where(F.col("idx") == idx).withColumn("idx", F.lit(after + 1).cast(log.schema["idx"].dataType)))


def delete(log: DataFrame, idx: int) -> DataFrame:
    return log.where(F.col("idx") != idx)


def reorder(log: DataFrame, one: int, two: int) -> DataFrame:
    """log with two lines swapped."""
    return log.withColumn("idx", F.when(F.col("idx") == one, two).when(F.col("idx") == two, one).otherwise(F.col("idx")).cast(log.schema["idx"].dataType))


def chained(records: DataFrame, content: str) -> DataFrame:
    """Honest log rows (chain, idx, seq, prev_hash, record_hash) of records (chain, idx, content): a record's hash covers its content."""
    w = W.partitionBy("chain").orderBy("idx")
    r = records.withColumn("record_hash", F.sha2(F.concat_ws("|", "chain", "idx", content), 256))
    return r.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("prev_hash", F.lag("record_hash", 1, logs.GENESIS).over(w))
