"""Benchmark decontamination by template canonicalisation.

Texts become tokens in which numbers, names and units are typed placeholders. Windows of ``window`` tokens of the
benchmark items are joined by hash to those of the documents. A document is contaminated by an item if at least
``min_share`` of the item's windows occur in it with consistent slots: along one alignment, equal item values stand
for equal document values and different ones for different ones. So a question whose numbers or names were changed
throughout is caught, and a text that only shares the template's shape with clashing values is not.

Names are capitalised words that follow a lower-case letter, digit or comma (so not those that start a sentence);
units count as such after a number. A text with fewer tokens than a window is one window, and matches only a text
with the same tokens. Windows with fewer than half of their tokens literal are left out: they'd match anything.

Items shorter than a window, and items that only have left-out windows (arithmetic, lists of names), are found verbatim:
their plain tokens, words and numbers in lower case, must stand in the text one after the other. Items of fewer
than ``least_inside`` plain tokens must be the whole text: at the default of ``LEAST_INSIDE`` an item of one or two words
doesn't contaminate every text that holds these. At 1 all are found anywhere.

Edge cases: null or empty texts match nothing; items with the same windows and slot values (copies) are reported under the smallest item_id;
null ids are kept as such; repeated documents are each counted under their id; empty tables give no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored, table

WINDOW = 8
MIN_SHARE = 0.5
LEAST_INSIDE = 3
UNITS = "kg|km|cm|mm|mg|ml|lb|lbs|oz|mi|ft|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|kw|kwh|percent|euros?|dollars?|pounds?|meters?|metres?|miles?|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
_NAME, _UNIT = "\x01", "\x02"
# groups repeat possessively: others take a stack frame for each repeat, and a long run of names or numbers ends the executor
_NAMES = r"([\p{Ll}\p{N},;] )(\p{Lu}[\p{Ll}\p{M}]+(?: \p{Lu}[\p{Ll}\p{M}]+)*+)"
_TOKEN = r"\x01\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*+|\x02?[\p{L}\p{M}\p{N}]+(?:[.,:/]\p{N}+)*+"
_PLAIN = r"[\p{L}\p{M}\p{N}]+(?:[.,:/]\p{N}+)*+"


def raw_tokens(text: Column) -> Column:
    """Tokens of a text; names start with \\x01 and units with \\x02."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), _NAME + _UNIT, "")
    t = F.regexp_replace(t, _NAMES, "$1\x01$2")
    t = F.when(F.rlike(t, F.lit(r"\p{N}")), F.regexp_replace(t, rf"(?i)(\p{{N}}) ?({UNITS})\b", "$1 \x02$2")).otherwise(t)
    return F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    first = F.substr(token, F.lit(1), F.lit(1))
    return F.when(first == _NAME, "<name>").when(first == _UNIT, "<unit>").when(first.between("0", "9"), "<number>").otherwise(F.lower(token))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))


def _windows(df: DataFrame, window: int) -> DataFrame:
    """df with _h: the hashes of the windows of raw tokens _raw."""
    df = _once(df, "_c", F.transform("_raw", lambda t: F.xxhash64(canonical(t))))
    n = F.size("_c")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    return df.withColumn("_h", F.when(n > 0, F.transform(starts, lambda i: F.xxhash64(F.slice("_c", i, window)))).otherwise(F.array().cast("array<bigint>"))).drop("_c")


def plain_tokens(text: Column) -> Column:
    """Words and numbers in lower case, whatever stands around them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_PLAIN), F.lit(0))


def is_slot(token: Column) -> Column:
    return canonical(token).startswith("<")


def exact_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, least_inside: int = LEAST_INSIDE) -> DataFrame:
    """(h, k, item_id, item_at, n_blocks, whole): blocks of up to window plain tokens, which cover each item that windows can't find inside a text."""
    b = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("t"))
    b = _once(_once(b, "_raw", raw_tokens(F.col("t"))), "_p", plain_tokens(F.col("t"))).where(F.size("_p") > 0)
    n = F.size("_raw")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    heavy = F.forall(F.transform(starts, lambda i: F.slice("_raw", i, window)), lambda w: 2 * F.size(F.filter(w, is_slot)) > F.size(w))
    b = b.where((n < window) | heavy).groupBy("_p").agg(F.min("item_id").alias("item_id"))
    n = F.size("_p")
    k = F.least(n, F.lit(window))
    # blocks from the first token on, and the last one up to the end
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1, F.lit(window)), lambda i: F.least(i, n - k)))
    b = _once(b, "_at", at).select("item_id", "_p", k.alias("k"), F.size("_at").cast("long").alias("n_blocks"), F.when(n < least_inside, n).alias("whole"), F.explode("_at").alias("item_at"))
    return b.select(F.xxhash64(F.slice("_p", F.col("item_at") + 1, F.col("k"))).alias("h"), "k", "item_id", "item_at", "n_blocks", "whole")


def _exact(plain: DataFrame, items: DataFrame, n_items: int, lengths: list[int]) -> DataFrame:
    """The documents (doc_id, t) that hold all blocks of an item at one place, as rows of contaminated."""
    rows = _once(plain, "_p", plain_tokens(F.col("t"))).select("doc_id", "_p")
    none = F.array().cast("array<struct<k:int,at:int,h:bigint>>")

    def blocks(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("_p") - k)
        return F.when(F.size("_p") >= k, F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), F.xxhash64(F.slice("_p", i + 1, k)).alias("h")))).otherwise(none)

    rows = rows.select("doc_id", F.size("_p").alias("size"), F.explode(F.concat(*map(blocks, lengths))).alias("w")).select("doc_id", "size", "w.k", "w.at", "w.h")
    hits = rows.join(maybe_broadcast(items, n_items), ["h", "k"]).where(F.col("whole").isNull() | (F.col("whole") == F.col("size")))
    found = hits.groupBy("doc_id", "item_id", "n_blocks", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count_distinct("item_at").alias("n")).where(F.col("n") == F.col("n_blocks"))
    found = found.select("doc_id", "item_id", "n_blocks").distinct()
    return found.select("doc_id", "item_id", F.col("n_blocks").alias("n_matched"), F.col("n_blocks").alias("n_windows"), F.lit(1.0).alias("share"), F.lit("verbatim").alias("kind"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, item_id, item_at, n_windows, slots): one row per literal enough window of each distinct item."""
    b = _once(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("t")), "_raw", raw_tokens(F.col("t")))
    b = _windows(b.select("item_id", "_raw"), window).where(F.size("_h") > 0)
    values = F.transform("_raw", lambda t: F.when(is_slot(t), F.lower(t)).otherwise(F.lit("")))
    b = b.select("item_id", "_raw", F.xxhash64("_h", values).alias("same"), F.posexplode("_h").alias("item_at", "h"))
    mine = F.slice("_raw", F.col("item_at") + 1, window)
    slots = F.filter(F.transform(mine, lambda t, i: F.struct(i.alias("at"), F.when(is_slot(t), F.lower(t)).alias("value"))), lambda s: s["value"].isNotNull())
    b = b.select("item_id", "h", "item_at", "same", slots.alias("slots"), F.size(mine).alias("k")).where(2 * F.size("slots") <= F.col("k"))
    # of items with the same windows and slot values one stays: links are not multiplied by copies of an item
    first = b.groupBy("same").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_at").cast("long").alias("n_windows"))
    return b.join(first, ["same", "item_id"]).select("h", "item_id", "item_at", "n_windows", "slots").dropDuplicates(["h", "item_id", "item_at"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, least_inside: int = LEAST_INSIDE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, share, kind): one row per contaminated document and item.

    kind is 'verbatim' where all slot values are equal, else 'reparameterised'. The documents' windows stream past a
    broadcast table of benchmark windows if those are few enough, and are shuffled by hash otherwise.
    """
    bench = stored(benchmark_windows(benchmark, window=window), "bench")
    size = F.aggregate("slots", F.lit(0), lambda n, s: n + F.octet_length(s["value"]) + 32)
    n_bench, n_slots, slot_bytes = bench.select(F.count("*"), F.count_if(F.size("slots") > 0), F.coalesce(F.sum(size), F.lit(0))).first()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    tokens = lambda df: _once(df, "_raw", raw_tokens(F.col("t"))).select("doc_id", "_raw")
    rows = _windows(tokens(plain), window).select("doc_id", F.posexplode("_h").alias("at", "h"))
    hits = rows.join(maybe_broadcast(bench.select("h", "item_id", "item_at", "n_windows"), n_bench), "h").select("doc_id", "item_id", "item_at", "at", "n_windows")
    hits = stored(hits, "hits")
    bad = None
    values = None
    if n_slots:
        with_slots = hits.join(maybe_broadcast(bench.where(F.size("slots") > 0).select("item_id", "item_at", "slots"), n_slots, slot_bytes), ["item_id", "item_at"])
        # each place that a slot asks for, once an item and alignment; a document's tokens are shuffled one by one, not copied to its hits
        places = F.transform("slots", lambda s: F.struct((F.col("at") + s["at"]).alias("place"), s["value"].alias("item")))
        asked = stored(with_slots.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), F.explode(places).alias("v")).select("doc_id", "item_id", "shift", "v.place", "v.item").distinct(), "slots")
        ids = stored(asked.select("doc_id").distinct(), "slot-docs")
        texts = tokens(plain.join(maybe_broadcast(ids, ids.count()), "doc_id"))
        held = texts.select("doc_id", F.posexplode("_raw").alias("place", "t")).where(is_slot(F.col("t"))).select("doc_id", "place", F.lower("t").alias("doc")).distinct()
        values = asked.join(held, ["doc_id", "place"]).select("doc_id", "item_id", "shift", "item", "doc").distinct().groupBy("doc_id", "item_id", "shift").agg(
            F.count("*").alias("n"), F.count_distinct("item").alias("ni"), F.count_distinct("doc").alias("nd"), F.bool_and(F.col("item") == F.col("doc")).alias("equal")
        )
        bad = values.select("doc_id", "item_id", "shift", "equal", ((F.col("n") == F.col("ni")) & (F.col("n") == F.col("nd"))).alias("consistent"))
    hits = hits.withColumn("shift", F.col("at") - F.col("item_at"))
    if bad is not None:
        hits = hits.join(bad, ["doc_id", "item_id", "shift"], "left").where(F.coalesce("consistent", F.lit(True)))
    else:
        hits = hits.withColumn("equal", F.lit(True))
    per = hits.groupBy("doc_id", "item_id", "n_windows", "item_at").agg(F.bool_or(F.coalesce("equal", F.lit(True))).alias("equal"))
    out = per.groupBy("doc_id", "item_id", "n_windows").agg(F.count("*").alias("n_matched"), F.bool_and("equal").alias("equal")).where(F.col("n_matched") >= min_share * F.col("n_windows"))
    out = out.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("share"), F.when(F.col("equal"), "verbatim").otherwise("reparameterised").alias("kind"))
    items = stored(exact_items(benchmark, window=window, least_inside=least_inside), "exact")
    lengths = {r["k"]: r["n"] for r in items.groupBy("k").agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return out
    both = out.unionByName(_exact(plain, items, sum(lengths.values()), sorted(lengths)))
    # of a pair that both ways find, the verbatim one stays
    best = F.max_by(F.struct("n_matched", "n_windows", "share", "kind"), F.struct("kind", "share"))
    return both.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that some item contaminates."""
    ids = stored(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(maybe_broadcast(ids, ids.count()), id_col, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items that they contain."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
