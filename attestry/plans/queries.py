"""Registered queries: each operator over a whole driver table, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.canonical import canonical_udf
from attestry.functions.grading import bounded, disposition_for, duplicate_score, severity_for, verdict_band
from attestry.functions.vectors import as_doubles, normalized
from attestry.operators import attacks, custody, detectors, findings, graph, layers, logs, metrics, outliers, resampling, rollup, scoring, shift, similarity
from attestry.session import shared_path, table
from attestry.streaming import logs as stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("contributor_id"), F.concat(F.lit("B"), F.col("doc_id") % 10).alias("batch_id"), F.col("lang").alias("label"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("sample_id"))


_RISK = """
WITH s AS (SELECT DISTINCT doc_id, {group} AS g FROM documents WHERE {group} IS NOT NULL),
f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
c AS (SELECT g, count(*) AS n, count(f.doc_id) AS k FROM s LEFT JOIN f ON s.doc_id = f.doc_id GROUP BY g),
j AS (SELECT g, n, k, unnest(range(0, k + 1)) AS j FROM c),
t AS (SELECT g, n, k, j, (n + 1) * ln(cast(0.95 AS double)) + sum(CASE WHEN j = 0 THEN 0 ELSE ln((n + 2 - j) / j) + ln(cast(0.05 AS double)) - ln(cast(0.95 AS double)) END) OVER (PARTITION BY g ORDER BY j) AS l FROM j),
p AS (SELECT g, any_value(n) AS n, any_value(k) AS k, least(1.0, sum(exp(l))) AS p FROM t GROUP BY g)
SELECT g AS {name}, n, k AS n_flagged, round(k / n, 6) AS rate, round(p, 6) AS p_above,
  CASE WHEN p > 0.9 AND n >= 30 THEN 'quarantine' WHEN p > 0.6 THEN 'review' ELSE 'accept' END AS disposition FROM p
"""


@query(_RISK.format(group="source", name="contributor_id"))
def contributor_risk(spark: SparkSession, d: str) -> DataFrame:
    return rollup.group_risk(_samples(spark, d), _flagged(spark, d), "contributor_id").select("contributor_id", "n", "n_flagged", *_r("rate", "p_above"), "disposition")


@query(_RISK.format(group="('B' || (doc_id % 10))", name="batch_id"))
def batch_risk(spark: SparkSession, d: str) -> DataFrame:
    return rollup.group_risk(_samples(spark, d), _flagged(spark, d), "batch_id").select("batch_id", "n", "n_flagged", *_r("rate", "p_above"), "disposition")


@query("""
WITH r AS (SELECT l_suppkey AS g, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) / count(DISTINCT l_orderkey * 10 + l_linenumber) AS rate FROM lineitem GROUP BY 1)
SELECT a.g AS supplier, round(any_value(a.rate), 6) AS rate, round(coalesce(max(b.rate), 0), 6) AS others_max, round(coalesce(median(b.rate), 0), 6) AS others_median
FROM r a LEFT JOIN r b ON a.g <> b.g GROUP BY a.g
""")
def contributor_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_returnflag")
    rates = li.groupBy("supplier").agg((F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("line"))) / F.count_distinct("line")).alias("rate"))
    return rollup.leave_one_out(rates, "supplier").select("supplier", *_r("rate", "others_max", "others_median"))


@query("""
WITH s AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents)
SELECT doc_id, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN score >= 0.8 THEN 'quarantine' WHEN score >= 0.5 THEN 'review' ELSE 'accept' END AS disposition,
 CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.35 THEN 'partial' ELSE 'unsupported' END AS verdict FROM s
""")
def grade_severity_disposition(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("n_chars") % 1000) / 1000.0
    return table(spark, d, "documents").select("doc_id", severity_for(s).alias("severity"), disposition_for(s).alias("disposition"), verdict_band(s).alias("verdict"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
""")
def modal_label(spark: SparkSession, d: str) -> DataFrame:
    return rollup.modal(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT count(*) AS n_samples, count(lang) AS n_labelled, count(nullif(source, '')) AS n_attributed, array_to_string(list_sort(list(DISTINCT lang)), ',') AS labels, array_to_string(list_sort(list(DISTINCT source)), ',') AS contributors FROM documents")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    return s.agg(F.count("*").alias("n_samples"), F.count("label").alias("n_labelled"), F.count(F.nullif("contributor_id", F.lit(""))).alias("n_attributed"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.array_join(F.array_sort(F.collect_set("contributor_id")), ",").alias("contributors"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("score"))
    return table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y")).join(docs, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


_SCORED = "WITH t AS (SELECT l.doc_id, 1 - quality AS y, coalesce((n_chars % 100) / 100.0::DOUBLE, 0) AS score FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)"
_ROC = _SCORED + """, g AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM t GROUP BY score),
roc AS (SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL SELECT score, sum(q) OVER (ORDER BY score DESC) / sum(q) OVER (), sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () FROM g)"""


@query(_SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM t) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(_scored(spark, d)).select(*_r("auroc"))


@query(_ROC + " SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_points(_scored(spark, d)).select("threshold", *_r("fpr", "tpr"))


@query(_ROC + ", p AS (SELECT fpr, max(tpr) AS tpr, min(tpr) AS low FROM roc GROUP BY fpr), lo AS (SELECT * FROM p WHERE fpr <= 0.1 ORDER BY fpr DESC LIMIT 1), hi AS (SELECT * FROM p WHERE fpr > 0.1 ORDER BY fpr LIMIT 1) SELECT round(lo.tpr + (0.1 - lo.fpr) / (hi.fpr - lo.fpr) * (hi.low - lo.tpr), 6) AS tpr FROM lo, hi")
def tpr_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tpr_at_fpr(_scored(spark, d), 0.1).select(*_r("tpr"))


@query(_SCORED + ", o AS (SELECT y, row_number() OVER w AS r, sum(y) OVER w AS tp FROM t WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(avg(tp / r), 6) AS average_precision FROM o WHERE y = 1")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, d), "doc_id").select(*_r("average_precision"))


@query(_SCORED + ", k AS (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 50) SELECT round(sum(y) / count(*), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM t), 6) AS recall FROM k")
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall_at(_scored(spark, d), "doc_id", 50).select(*_r("precision", "recall"))


_BINS = _SCORED + ", b AS (SELECT *, " + " + ".join(f"(score >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10)) + " AS bin FROM t), g AS (SELECT bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS rate FROM b GROUP BY bin)"


@query(_BINS + " SELECT bin, n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate FROM g")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reliability_bins(_scored(spark, d)).select("bin", "n", *_r("mean_score", "rate"))


@query(_BINS + " SELECT round(sum(n * abs(mean_score - rate)) / sum(n), 6) AS ece FROM g")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(_scored(spark, d)).select(*_r("ece"))


@query(_SCORED + " SELECT round(avg((score - y) ** 2), 6) AS brier FROM t")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(_scored(spark, d)).select(*_r("brier"))


@query(_SCORED + " SELECT y, count(*) FILTER (score < 0.5) AS accept, count(*) FILTER (score >= 0.5 AND score < 0.8) AS review, count(*) FILTER (score >= 0.8) AS quarantine FROM t GROUP BY y")
def disposition_confusion(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    worst = rollup.worst_disposition(s.where("score >= 0.5").select("doc_id", disposition_for(F.col("score")).alias("disposition")), "doc_id")
    return metrics.disposition_confusion(s.select("doc_id", "y"), worst, "doc_id")


@query("""
WITH m AS (SELECT lang, median(n_chars) AS med, stddev_pop(n_chars) AS sd FROM documents GROUP BY lang),
a AS (SELECT d.lang, 1.4826 * median(abs(n_chars - med)) AS mad FROM documents d JOIN m ON d.lang = m.lang GROUP BY d.lang)
SELECT doc_id, round((n_chars - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z,
  round(greatest((n_chars - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END, 0) ** 2 / (9 + greatest((n_chars - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END, 0) ** 2), 6) AS score
FROM documents d JOIN m ON d.lang = m.lang JOIN a ON d.lang = a.lang
""")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    z = outliers.robust_z(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "lang")
    return z.withColumn("score", bounded(F.col("z"), 3.0)).select("doc_id", *_r("z", "score"))


_NEAR = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM e),
p AS (SELECT a.vec_id AS id, a.label AS label, b.vec_id AS other, b.label AS l, round(list_dot_product(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM p QUALIFY rank <= 20)
"""


@query(_NEAR + "SELECT id, other, round(similarity, 6) AS similarity, rank FROM n")
def pair_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return outliers.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20).select("id", "other", *_r("similarity"), "rank")


@query(_NEAR + """, c AS (SELECT id, any_value(label) AS label, l, count(*) AS n, min(rank) AS r FROM n GROUP BY id, l),
m AS (SELECT id, label, l AS majority, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, r) = 1),
g AS (SELECT m.*, coalesce((SELECT n FROM c WHERE c.id = m.id AND c.l = m.label), 0) / 20 AS agreement FROM m)
SELECT id, label, majority, round(agreement, 6) AS agreement, round((1 - agreement) * n / 20, 6) AS score FROM g""")
def knn_label_noise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = outliers.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20)
    return outliers.label_disagreement(near, e.select(F.col("vec_id").alias("id"), "label"), 20).select("id", "label", "majority", *_r("agreement", "score"))


_OOD = """
WITH s AS (SELECT vec_id AS id, label, count(*) OVER (PARTITION BY label) AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
x AS (SELECT id, label, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s WHERE n >= 8),
c0 AS (SELECT label, i, median(x) AS c FROM x GROUP BY 1, 2),
d0 AS (SELECT x.label, id, any_value(n) AS n, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c0 USING (label, i) GROUP BY 1, 2),
k0 AS (SELECT id FROM d0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= greatest(4, floor(n * 0.7))),
c1 AS (SELECT label, i, avg(x) AS c FROM x WHERE id IN (SELECT id FROM k0) GROUP BY 1, 2),
d1 AS (SELECT x.label, id, any_value(n) AS n, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c1 USING (label, i) GROUP BY 1, 2),
k1 AS (SELECT id FROM d1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= greatest(4, floor(n * 0.7))),
c2 AS (SELECT label, i, avg(x) AS c FROM x WHERE id IN (SELECT id FROM k1) GROUP BY 1, 2),
d2 AS (SELECT x.label, id, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c2 USING (label, i) GROUP BY 1, 2),
t AS (SELECT label, median(d) AS t FROM d2 WHERE id IN (SELECT id FROM k1) GROUP BY label)
"""


@query(_OOD + "SELECT id, label, round(d, 6) AS distance, round(d / t, 6) AS ratio, round((d / t) ** 3 / (8 + (d / t) ** 3), 6) AS score FROM d2 JOIN t USING (label)")
def ood_class_distance(spark: SparkSession, d: str) -> DataFrame:
    return outliers.class_distances(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("id", "label", *_r("distance", "ratio", "score"))


@query("""
WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS tile FROM embeddings),
m AS (SELECT tile, median(x) AS m FROM x GROUP BY tile), a AS (SELECT tile, median(abs(x - m)) AS mad FROM x JOIN m USING (tile) GROUP BY tile),
z AS (SELECT id, tile, abs(x - m) / (1.4826 * mad + 1e-9) AS z FROM x JOIN m USING (tile) JOIN a USING (tile)),
h AS (SELECT tile, avg((z > 4)::INT) AS hot_rate FROM z GROUP BY tile),
w AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, tile) = 1)
SELECT id, tile::INT AS worst_tile, round(z, 6) AS worst_z, z > 4 AS hot, round(CASE WHEN z > 4 THEN hot_rate ELSE 0 END, 6) AS consistency FROM w JOIN h USING (tile)
""")
def tile_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return outliers.tile_anomaly(table(spark, d, "embeddings"), "vec_id", "embedding").select("id", F.col("worst_tile").cast("int").alias("worst_tile"), *_r("worst_z"), "hot", *_r("consistency"))


@query("""
WITH t AS (SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS first, count(*) AS size, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) >= 2)
SELECT first, size, sources, round(greatest(0, least(0.97, 0.55 + 0.05 * (size - 3)))::DOUBLE, 6) AS score FROM t
""")
def near_dup_exact(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("size"), F.count_distinct("source").alias("sources")).where("size >= 2")
    return g.select("first", "size", "sources", F.round(duplicate_score(F.col("size")), 6).alias("score"))


@query("""
WITH e AS (SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i) ELSE 0::UBIGINT END), lambda a, b: a | b) AS h FROM embeddings),
u AS (SELECT vec_id, h FROM e UNION ALL SELECT vec_id + 1000000, xor(h, (5::UBIGINT << (vec_id % 60))) FROM e WHERE vec_id % 5 = 0),
f AS (SELECT h, min(vec_id) AS vec_id FROM u GROUP BY h)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM f a JOIN f b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 8
UNION ALL SELECT f.vec_id, u.vec_id, 0 FROM u JOIN f ON u.h = f.h WHERE u.vec_id <> f.vec_id
""")
def near_dup_hamming(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_hash(as_doubles(F.col("embedding"))).alias("hash"))
    # planted near copies: the table holds none of its own
    planted = h.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("hash").bitwiseXOR(F.expr("shiftleft(5L, cast(id % 60 as int))")).alias("hash"))
    return similarity.hamming_pairs(h.unionByName(planted)).select("a", "b", F.col("distance").cast("int").alias("distance"))


_LOG = """
WITH base AS (SELECT event_id AS idx, event_id AS seq0, user_id % 4 AS chain, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, props FROM events),
h AS (SELECT *, sha256(chain || '|' || idx || '|' || props) AS record_hash FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY idx) AS line, coalesce(lag(record_hash) OVER (PARTITION BY chain ORDER BY idx), repeat('0', 64)) AS link FROM h),
l AS (SELECT chain, idx, CASE WHEN idx % 97 = 5 THEN line - 3 WHEN idx % 89 = 7 THEN line + 2 ELSE line END AS seq, CASE WHEN idx % 101 = 3 THEN repeat('f', 64) ELSE link END AS prev_hash, record_hash,
  CASE WHEN idx % 113 = 9 THEN 'n-shared' ELSE 'n' || idx END AS nonce, CASE WHEN idx % 71 = 4 THEN '1999-01-01T00:00:00' ELSE ts END AS ts FROM r),
w AS (SELECT *, lag(record_hash, 1, repeat('0', 64)) OVER o AS expected, max(seq) OVER b AS top, max(ts) OVER b AS latest, lag(idx) OVER (PARTITION BY chain, seq ORDER BY idx) AS used, min(idx) OVER (PARTITION BY chain, nonce) AS nonce_at FROM l
  WINDOW o AS (PARTITION BY chain ORDER BY idx), b AS (PARTITION BY chain ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT chain, idx, seq, 'CHAIN_BROKEN' AS code FROM w WHERE prev_hash <> expected
  UNION ALL SELECT chain, idx, seq, CASE WHEN used IS NOT NULL OR seq < top THEN 'SEQUENCE_REPLAY' ELSE 'SEQUENCE_GAP' END FROM w WHERE used IS NOT NULL OR seq < top OR seq > top + 1
  UNION ALL SELECT chain, idx, seq, 'NONCE_REUSE' FROM w WHERE nonce_at < idx UNION ALL SELECT chain, idx, seq, 'TIMESTAMP_REGRESSION' FROM w WHERE ts < latest)
"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 4).alias("chain"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "props")
    e = e.withColumn("record_hash", F.sha2(F.concat_ws("|", "chain", "idx", "props"), 256))
    w = W.partitionBy("chain").orderBy("idx")
    e = e.withColumn("line", F.row_number().over(w)).withColumn("link", F.lag("record_hash", 1, logs.GENESIS).over(w))
    fault = lambda m, r: F.col("idx") % m == r
    return e.select(
        "chain", "idx", F.when(fault(97, 5), F.col("line") - 3).when(fault(89, 7), F.col("line") + 2).otherwise(F.col("line")).cast("long").alias("seq"),
        F.when(fault(101, 3), "f" * 64).otherwise(F.col("link")).alias("prev_hash"), "record_hash",
        F.when(fault(113, 9), "n-shared").otherwise(F.concat(F.lit("n"), "idx")).alias("nonce"), F.when(fault(71, 4), "1999-01-01T00:00:00").otherwise(F.col("ts")).alias("ts"),
    )


@query(_LOG + "SELECT * FROM f")
def log_verify(spark: SparkSession, d: str) -> DataFrame:
    return logs.verify_log(_log(spark, d))


@query(_LOG + """, n AS (SELECT chain, idx, row_number() OVER (PARTITION BY chain ORDER BY idx) - 1 AS before FROM l), t AS (SELECT chain, count(*) AS total FROM l GROUP BY chain),
g AS (SELECT chain, count(*) AS n_failures, min(idx) AS first_bad FROM f GROUP BY chain)
SELECT t.chain, total, coalesce(n_failures, 0) AS n_failures, first_bad, coalesce(n.before, total) AS n_verified FROM t LEFT JOIN g ON t.chain = g.chain LEFT JOIN n ON n.chain = g.chain AND n.idx = g.first_bad""")
def log_verify_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.summary(_log(spark, d))


@query(_LOG + """, e AS (SELECT f.*, CASE code WHEN 'SEQUENCE_REPLAY' THEN used WHEN 'NONCE_REUSE' THEN nonce_at END AS earlier, CASE WHEN code = 'SEQUENCE_GAP' THEN top + 1 END AS missing_from, CASE WHEN code = 'SEQUENCE_GAP' THEN f.seq - 1 END AS missing_to FROM f JOIN w ON w.chain = f.chain AND w.idx = f.idx) SELECT * FROM e""")
def log_verify_detail(spark: SparkSession, d: str) -> DataFrame:
    return logs.verify_log_detail(_log(spark, d))


@query("""
WITH c AS (SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || text) AS o FROM conversations),
h AS (SELECT conv_id AS chain, turn AS hop, CASE WHEN (conv_id + turn) % 13 = 6 THEN repeat('e', 64) ELSE lag(o, 1, repeat('0', 64)) OVER w END AS i, lag(o, 1, repeat('0', 64)) OVER w AS x FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT chain, hop FROM h WHERE i <> x
""")
def handoff_verify(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("hop"), F.sha2(F.concat_ws("|", "conv_id", "turn", "text"), 256).alias("output_digest"))
    honest = F.lag("output_digest", 1, logs.GENESIS).over(W.partitionBy("chain").orderBy("hop"))
    c = c.withColumn("input_digest", F.when((F.col("chain") + F.col("hop")) % 13 == 6, "e" * 64).otherwise(honest))
    return logs.verify_handoffs(c)


_SHIFT = """
WITH m AS (SELECT l_orderkey % 2 = 1 AS o, unnest([{'m': 'quantity', 'v': l_quantity::DOUBLE}, {'m': 'discount', 'v': l_discount::DOUBLE}, {'m': 'tax', 'v': l_tax::DOUBLE}, {'m': 'price', 'v': l_extendedprice::DOUBLE + CASE WHEN l_orderkey % 2 = 1 THEN 9000 ELSE 0 END}]) AS x FROM lineitem),
r AS (SELECT o, x.m AS measure, x.v AS v FROM m),
c AS (SELECT measure, v, count(*) FILTER (NOT o) AS a, count(*) FILTER (o) AS b FROM r GROUP BY 1, 2),
g AS (SELECT measure, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM c WINDOW w AS (PARTITION BY measure ORDER BY v), p AS (PARTITION BY measure)),
d AS (SELECT measure, max(gap) AS d FROM g GROUP BY measure),
e AS (SELECT measure, (avg(v) FILTER (o) - avg(v) FILTER (NOT o)) / sqrt((var_pop(v) FILTER (o) + var_pop(v) FILTER (NOT o)) / 2) AS effect, count(*) FILTER (NOT o) AS n_reference, count(*) FILTER (o) AS n_observed FROM r GROUP BY measure)
"""


def _measures(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    odd = F.col("l_orderkey") % 2 == 1
    x = F.array(*(F.struct(F.lit(n).alias("measure"), v.cast("double").alias("value")) for n, v in (("quantity", F.col("l_quantity")), ("discount", F.col("l_discount")), ("tax", F.col("l_tax")), ("price", F.col("l_extendedprice").cast("double") + F.when(odd, 9000).otherwise(0)))))
    return li.select(odd.alias("observed"), F.explode(x).alias("x")).select("observed", "x.measure", "x.value")


@query(_SHIFT + "SELECT d.measure, round(d, 6) AS d, round(effect, 6) AS effect, n_reference, n_observed FROM d JOIN e ON d.measure = e.measure")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return shift.ks_statistic(_measures(spark, d)).select("measure", *_r("d", "effect"), "n_reference", "n_observed")


@query(_SHIFT + ", s AS (SELECT measure, least(0.95, sum(abs(effect)) OVER () / (sum(abs(effect)) OVER () + 1.2)) * abs(effect) / sum(abs(effect)) OVER () AS share FROM e) SELECT measure, round(share, 4) AS share FROM s WHERE share >= 0.01")
def shift_attribution(spark: SparkSession, d: str) -> DataFrame:
    return shift.attribution(shift.ks_statistic(_measures(spark, d)))


@query("""
WITH t AS (SELECT vec_id, ((vec_id * 37) % 101 + 1) / 2020.0::DOUBLE AS p FROM embeddings),
r AS (SELECT *, least(1.0, p * count(*) OVER () / row_number() OVER (ORDER BY p, vec_id)) AS raw FROM t),
a AS (SELECT vec_id, min(raw) OVER (ORDER BY p, vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r)
SELECT vec_id, round(q, 6) AS p_adjusted, q < 0.05 AS significant FROM a
""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", (((F.col("vec_id") * 37) % 101 + 1) / 2020.0).alias("p"))
    return shift.benjamini_hochberg(t, "vec_id").select("vec_id", *_r("p_adjusted"), "significant")


_LAYERS = "WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, max(abs(x)) AS absmax, kurtosis_pop(x) AS kurtosis FROM v GROUP BY label)"


def _layer_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id", F.explode(as_doubles(F.col("embedding"))).alias("value"))


@query(_LAYERS + " SELECT label, n, round(mean, 6) AS mean, round(std, 6) AS std, round(absmax, 6) AS absmax, round(kurtosis, 6) AS kurtosis FROM s")
def layer_stats(spark: SparkSession, d: str) -> DataFrame:
    return layers.layer_stats(_layer_values(spark, d), "label").select("label", "n", *_r("mean", "std", "absmax", "kurtosis"))


@query("""
WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
o AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM v WHERE label <> 9 GROUP BY label), e AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM v WHERE label <> 0 AND (label <> 3 OR vec_id % 2 = 0) GROUP BY label)
SELECT coalesce(o.label, e.label) AS label, CASE WHEN e.m IS NULL THEN 'new' WHEN o.m IS NULL THEN 'removed' ELSE 'changed' END AS status, round((o.m - e.m) / e.s, 6) AS mean_shift, round((o.s - e.s) / e.s, 6) AS std_change
FROM o FULL JOIN e ON o.label = e.label WHERE e.m IS NULL OR o.m IS NULL OR o.label = 3
""")
def layer_diff(spark: SparkSession, d: str) -> DataFrame:
    v = _layer_values(spark, d)
    rounded = lambda x: layers.layer_stats(x, "label").withColumn("mean", F.round("mean", 12)).withColumn("std", F.round("std", 12))
    out = layers.diff_layers(rounded(v.where("label <> 9")), rounded(v.where("label <> 0 and (label <> 3 or vec_id % 2 = 0)")), "label")
    return out.select("label", "status", *_r("mean_shift", "std_change"))


@query("""
SELECT doc_id AS sample_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'mapped' || (doc_id % 3) END, nullif(regexp_extract(source, 'src([0-4])', 1), ''), source) AS contributor_id FROM documents
""")
def attach_contributors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("path"), F.col("source").alias("contributor_id"))
    mapped = docs.where("sample_id % 7 = 0").select("sample_id", F.concat(F.lit("mapped"), F.col("sample_id") % 3).alias("contributor"))
    return findings.attach_contributors(docs, mapped, "src([0-4])", "path").select("sample_id", "contributor_id")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that stand for checks: two per document by its length, and one of a model's checks that couldn't run."""
    s = (F.col("n_chars") % 100) / 100.0
    docs = table(spark, d, "documents").select("doc_id", s.alias("score"))
    kind = F.when(F.col("doc_id") % 4 == 0, "trigger_freq").when(F.col("doc_id") % 4 == 1, "label_noise").when(F.col("doc_id") % 4 == 2, "near_duplicate").otherwise("contributor")
    attack = F.when(F.col("doc_id") % 4 == 0, "badnets_patch").when(F.col("doc_id") % 4 == 1, "label_flip").when(F.col("doc_id") % 4 == 2, "near_duplicate_flood").otherwise("systematic_mislabel")
    none = F.lit(None).cast("string")
    made = docs.select(
        F.col("doc_id").cast("string").alias("asset_ref"), F.when(F.col("doc_id") % 4 == 3, "contributor").otherwise("sample").alias("asset_type"), attack.alias("attack_class"), kind.alias("detector_id"),
        "score", disposition_for(F.col("score")).alias("disposition"), F.concat(F.lit("score "), F.when(F.col("doc_id") % 11 == 0, "by z-score").otherwise(F.col("score").cast("string"))).alias("reason"), none.alias("unavailable_reason"),
    )
    blocked = spark.sql("select 'm1' asset_ref, 'model' asset_type, 'model_substitute' attack_class, 'fingerprint' detector_id, 0D score, 'accept' disposition, 'not enrolled' reason, 'not enrolled' unavailable_reason")
    return made.unionByName(blocked)


_FINDINGS = """WITH s AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents),
f AS (SELECT doc_id::VARCHAR AS asset_ref, CASE WHEN doc_id % 4 = 3 THEN 'contributor' ELSE 'sample' END AS asset_type,
  CASE doc_id % 4 WHEN 0 THEN 'badnets_patch' WHEN 1 THEN 'label_flip' WHEN 2 THEN 'near_duplicate_flood' ELSE 'systematic_mislabel' END AS attack_class,
  CASE doc_id % 4 WHEN 0 THEN 'trigger_freq' WHEN 1 THEN 'label_noise' WHEN 2 THEN 'near_duplicate' ELSE 'contributor' END AS detector_id, score,
  CASE WHEN score >= 0.8 THEN 'quarantine' WHEN score >= 0.5 THEN 'review' ELSE 'accept' END AS disposition, doc_id % 11 = 0 AS odd FROM s)
"""


@query(_FINDINGS + "SELECT rule, count(*) AS n FROM (SELECT unnest(['jargon', 'no_number']) AS rule FROM f WHERE odd) GROUP BY rule")
def finding_violations(spark: SparkSession, d: str) -> DataFrame:
    v = findings.violations(F.col("score"), F.col("reason"), F.col("unavailable_reason"), F.col("asset_type"))
    return _findings(spark, d).select(F.explode(v).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(_FINDINGS + "SELECT DISTINCT asset_ref FROM f WHERE asset_type = 'sample' AND asset_ref NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def unmatched_findings(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return findings.unmatched(_findings(spark, d), truth)


@query(_FINDINGS + "SELECT l.doc_id::VARCHAR AS sample_id, 1 - quality AS y, coalesce(max(f.score), 0) AS score FROM labels l LEFT JOIN f ON f.asset_ref = l.doc_id::VARCHAR AND asset_type = 'sample' GROUP BY 1, 2")
def truth_scores(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), (1 - F.col("quality")).alias("y")).distinct()
    return findings.score_truth(_findings(spark, d), truth).select("sample_id", "y", "score")


@query(_FINDINGS + """, k(category, attack_class) AS (VALUES ('Trigger / pattern risk', 'badnets_patch'), ('Trigger / pattern risk', 'blended_trigger'), ('Label anomaly risk', 'label_flip'), ('Label anomaly risk', 'systematic_mislabel'),
  ('Duplicate / near-duplicate risk', 'near_duplicate_flood'), ('OOD / distribution risk', 'ood_insertion')),
g AS (SELECT category, count(f.score) AS n, count(*) FILTER (disposition <> 'accept') AS fl, count(*) FILTER (disposition = 'quarantine') AS q, coalesce(max(score), 0) AS top FROM k LEFT JOIN f ON f.attack_class = k.attack_class AND asset_type = 'sample' GROUP BY category)
SELECT category, n AS n_checked, fl AS n_flagged, CASE WHEN top >= 0.9 THEN 'critical' WHEN top >= 0.7 THEN 'high' WHEN top >= 0.45 THEN 'medium' ELSE 'low' END AS level, CASE WHEN q > 0 THEN 'quarantine' WHEN fl > 0 THEN 'review' ELSE 'accept' END AS status FROM g""")
def category_risk(spark: SparkSession, d: str) -> DataFrame:
    return findings.category_risk(_findings(spark, d))


_CHECK_ROWS = ", ".join(f"('{a}', '{c}')" for a, checks in findings.CHECKS for c in checks)


@query(_FINDINGS + f""", k(attack_class, detector_id) AS (VALUES {_CHECK_ROWS}), n AS (SELECT detector_id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT attack_class, round(avg((score >= 0.8)::INT), 6) AS tpr FROM f WHERE attack_class <> 'label_flip' GROUP BY 1)
SELECT k.attack_class, k.detector_id, coalesce(n, 0) AS n_made, tpr, CASE WHEN n IS NULL THEN 'unsupported' WHEN tpr IS NULL THEN 'not measured' WHEN tpr >= 0.8 THEN 'strong' WHEN tpr >= 0.6 THEN 'good' WHEN tpr >= 0.35 THEN 'partial' ELSE 'unsupported' END AS status
FROM k LEFT JOIN n ON k.detector_id = n.detector_id LEFT JOIN m ON k.attack_class = m.attack_class""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    measured = f.where("unavailable_reason is null and attack_class <> 'label_flip'").groupBy("attack_class").agg(F.round(F.avg((F.col("score") >= 0.8).cast("double")), 6).alias("tpr"))
    return findings.coverage(f, measured)


@query(_FINDINGS + "SELECT CASE WHEN count(*) FILTER (disposition = 'quarantine') > 0 THEN 'red' ELSE 'amber' END AS verdict, count(*) FILTER (disposition = 'quarantine') AS n_quarantine, count(*) FILTER (disposition = 'review') AS n_review, 'not verified' AS model FROM f")
def overall_verdict(spark: SparkSession, d: str) -> DataFrame:
    return findings.overall_verdict(_findings(spark, d))


@query("""WITH u AS (SELECT doc_id, ('0x' || substr(md5('split|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.4 THEN 'fit' WHEN u < 0.7 THEN 'calibrate' ELSE 'test' END AS split FROM u""")
def three_way_split(spark: SparkSession, d: str) -> DataFrame:
    return findings.split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT md5(coalesce(text, '')) AS text_key, 2 AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), (F.col("doc_id") % 2).alias("split"))
    return findings.split_leakage(s, "text_key")


@query("SELECT l_linestatus AS attack, count(*) AS n, round(avg(l_discount::DOUBLE), 6) AS mean, round(stddev_samp(l_discount::DOUBLE), 6) AS sd, min(l_discount::DOUBLE) AS low, median(l_discount::DOUBLE) AS median, max(l_discount::DOUBLE) AS high FROM lineitem GROUP BY 1")
def sweep_aggregate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("attack"), F.col("l_discount").cast("double").alias("tpr"))
    return findings.spread(li, "attack", "tpr").select("attack", "n", *_r("mean", "sd"), "low", "median", "high")


@query("""WITH m AS (SELECT median(value::DOUBLE) AS med FROM events), s AS (SELECT median(abs(value::DOUBLE - med)) * 1.4826 AS s FROM events, m) SELECT event_id, round((med - value::DOUBLE) / s, 6) AS index FROM events, m, s""")
def mad_index(spark: SparkSession, d: str) -> DataFrame:
    return outliers.mad_index(table(spark, d, "events").select("event_id", F.col("value").cast("double").alias("value")), "value").select("event_id", *_r("index"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT id, round(avg(d), 6) AS distance FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 5) GROUP BY id""")
def ood_knn_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return outliers.mean_distance(e.where("vec_id % 50 = 0"), e, "vec_id", "label", "embedding").select("id", *_r("distance"))


_COPIES = """
WITH RECURSIVE e AS (SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i) ELSE 0::UBIGINT END), lambda a, b: a | b) AS h FROM embeddings),
u AS (SELECT vec_id, h FROM e UNION ALL SELECT vec_id + 1000000, xor(h, (5::UBIGINT << (vec_id % 60))) FROM e WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id + 2000000, h FROM e WHERE vec_id % 10 = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 8),
r(id, c) AS (SELECT vec_id, vec_id FROM u UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.id),
l AS (SELECT id, min(c) AS component FROM r GROUP BY id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM l QUALIFY size >= 3
"""


@query(_COPIES)
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_hash(as_doubles(F.col("embedding"))).alias("hash"))
    near = h.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("hash").bitwiseXOR(F.expr("shiftleft(5L, cast(id % 60 as int))")).alias("hash"))
    same = h.where("id % 10 = 0").select((F.col("id") + 2_000_000).alias("id"), "hash")
    return graph.clusters(similarity.hamming_pairs(h.unionByName(near).unionByName(same)).select("a", "b"))


@query(_SHIFT + """, t AS (SELECT sum(abs(effect)) AS w FROM e) SELECT round(least(0.95, w / (w + 1.2)), 6) AS explained, CASE WHEN 1 - least(0.95, w / (w + 1.2)) > 0.45 THEN 'SUSPICIOUS' ELSE 'DRIFT' END AS kind FROM t""")
def shift_classify(spark: SparkSession, d: str) -> DataFrame:
    t = shift.ks_statistic(_measures(spark, d)).agg(F.sum(F.abs("effect")).alias("w"))
    explained = F.least(F.lit(0.95), F.col("w") / (F.col("w") + 1.2))
    return t.select(F.round(explained, 6).alias("explained"), shift.classify(F.lit(1.0), 1 - explained, F.lit(False), F.lit(False)).alias("kind"))


_SOURCE_COUNTS = "SELECT count(contributor_id) AS attributed, count(*) AS total FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN source END AS contributor_id FROM documents)"


@query(_SOURCE_COUNTS)
def attribution_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("contributor_id"))
    return s.agg(F.count("contributor_id").alias("attributed"), F.count("*").alias("total"))


@query(_LOG + "SELECT chain::VARCHAR AS chain, idx, seq, code FROM f")
def log_verify_stream(spark: SparkSession, d: str) -> DataFrame:
    base = shared_path(spark, "stream")
    log = _log(spark, d)
    log.write.parquet(f"{base}/log")
    schema = log.schema
    stream.verify(spark.readStream.schema(schema).parquet(f"{base}/log"), f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.OUT).parquet(*(f"{base}/out/part={k}" for k in range(3)))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("idx"), F.col("role").alias("actor_id"), F.coalesce("text", F.lit("")).alias("text"))
    c = custody.chained(c, "text").withColumn("seed", F.unhex(F.sha2(F.concat(F.lit("key|"), "actor_id"), 256)))
    c = custody.signed(c, "record_hash", "seed")
    return custody.alter_where(c, (F.col("chain") + F.col("idx")) % 17 == 3, record_hash=F.sha2(F.lit("edited"), 256))


@query("SELECT conv_id AS chain, turn AS idx, CASE WHEN role = 'assistant' OR (conv_id + turn) % 17 = 3 THEN CASE WHEN role = 'assistant' THEN 'UNKNOWN_ACTOR' ELSE 'SIGNATURE_INVALID' END END AS code FROM conversations WHERE role = 'assistant' OR (conv_id + turn) % 17 = 3")
def signature_verify(spark: SparkSession, d: str) -> DataFrame:
    h = _hops(spark, d)
    return custody.signature_failures(h, _keyring(spark, d).where("actor_id <> 'assistant'")).select("chain", "idx", "code")


def _keyring(spark: SparkSession, d: str) -> DataFrame:
    from attestry.functions.ed25519 import public_key

    roles = [r[0] for r in table(spark, d, "conversations").select("role").distinct().collect()]  # one key a role
    import hashlib

    return spark.createDataFrame([(r, bytearray(public_key(hashlib.sha256(f"key|{r}".encode()).digest()))) for r in roles if r], "actor_id string, key binary")


_CUSTODY = """
WITH c AS (SELECT conv_id AS chain, turn AS idx, role, row_number() OVER w AS line, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, CASE WHEN (chain + idx) % 19 = 4 THEN line + 2 WHEN (chain + idx) % 23 = 5 THEN line - 1 ELSE line END AS seq, (chain + idx) % 31 = 7 AS torn, (chain + idx) % 17 = 3 AS edited, (chain + idx) % 13 = 6 AS swapped, (chain + idx) % 29 = 8 AS late FROM c),
g AS (SELECT *, lag(line, 1, 0) OVER o AS before, lag(edited, 1, false) OVER o AS was_edited, lag(swapped, 1, false) OVER o AS was_swapped, max(seq) OVER b AS top, max(CASE WHEN late THEN 0 ELSE line END) OVER b AS latest,
  lag(idx) OVER (PARTITION BY chain, seq ORDER BY idx) AS used FROM h WHERE NOT torn WINDOW o AS (PARTITION BY chain ORDER BY idx), b AS (PARTITION BY chain ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT chain, idx, NULL::BIGINT AS seq, 'MALFORMED' AS code FROM h WHERE torn
UNION ALL SELECT chain, idx, seq, 'UNKNOWN_ACTOR' FROM g WHERE role = 'assistant'
UNION ALL SELECT chain, idx, seq, 'SIGNATURE_INVALID' FROM g WHERE role <> 'assistant' AND edited
UNION ALL SELECT chain, idx, seq, 'CHAIN_BROKEN' FROM g WHERE before <> line - 1 OR was_edited
UNION ALL SELECT chain, idx, seq, 'HANDOFF_MISMATCH' FROM g WHERE before <> line - 1 OR was_swapped
UNION ALL SELECT chain, idx, seq, CASE WHEN used IS NOT NULL OR seq < top THEN 'HOP_REPLAY' ELSE 'HOP_GAP' END FROM g WHERE used IS NOT NULL OR seq < top OR seq > top + 1
UNION ALL SELECT chain, idx, seq, 'TIMESTAMP_REGRESSION' FROM g WHERE late AND latest > 0
"""


@query(_CUSTODY)
def custody_verify(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as custody chains: a hop takes up the digest that the last one put out; faults of all eight kinds are planted."""
    from pyspark.sql import Window as W

    at = lambda m, r: (F.col("chain") + F.col("idx")) % m == r
    h, w = _hops(spark, d), W.partitionBy("chain").orderBy("idx")
    out = F.sha2(F.concat_ws("|", "chain", "idx", "text"), 256)
    h = h.withColumn("line", F.col("seq")).withColumn("out", out)
    h = h.withColumn("input_digest", F.lag("out", 1, logs.GENESIS).over(w)).withColumn("output_digest", F.when(at(13, 6), F.sha2(F.lit("swapped"), 256)).otherwise(F.col("out")))
    h = h.withColumn("seq", F.when(at(31, 7), None).when(at(19, 4), F.col("line") + 2).when(at(23, 5), F.col("line") - 1).otherwise(F.col("line")).cast("long"))
    return custody.verify_custody(h.withColumn("ts", F.lpad(F.when(at(29, 8), 0).otherwise(F.col("line")).cast("string"), 9, "0")), _keyring(spark, d).where("actor_id <> 'assistant'"))


@query(_LOG + ", p(code, rank) AS (VALUES ('MALFORMED', 1), ('SEQUENCE_REPLAY', 2), ('NONCE_REUSE', 3), ('SEQUENCE_GAP', 4), ('TIMESTAMP_REGRESSION', 6), ('CHAIN_BROKEN', 7)) SELECT chain, seq, min(idx) AS idx, min_by(f.code, rank) AS code, array_to_string(list_sort(list(DISTINCT f.code)), ',') AS codes FROM f JOIN p ON f.code = p.code GROUP BY chain, seq")
def log_headlines(spark: SparkSession, d: str) -> DataFrame:
    return custody.headlines(logs.verify_log(_log(spark, d))).withColumn("codes", F.array_join("codes", ","))


@query()
def beta_credible_interval(spark: SparkSession, d: str) -> DataFrame:
    g = rollup.group_risk(_samples(spark, d), _flagged(spark, d), "contributor_id")
    low, high = resampling.credible_interval(F.col("n_flagged"), F.col("n"))
    return g.select("contributor_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def bootstrap_auroc(spark: SparkSession, d: str) -> DataFrame:
    return resampling.auroc_interval(_scored(spark, d))


@query()
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = findings.split(_scored(spark, d), "doc_id")
    return resampling.isotonic(s.where("split = 'calibrate'"), s).select("doc_id", "split", "y", "score", "calibrated")


@query()
def spectral_projection(spark: SparkSession, d: str) -> DataFrame:
    p = resampling.projections(table(spark, d, "embeddings"), "vec_id", "label", "embedding")
    z = outliers.robust_z(p, "projection", "label")
    return z.withColumn("score", bounded(F.col("z"), 3.0)).select("id", "label", *_r("projection", "z", "score"))


@query()
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", canonical_udf()("props").alias("canonical"))
    return e.withColumn("digest", F.sha2("canonical", 256))


@query(_OOD + """, f AS (SELECT id, label, d / t AS r, (d / t) ** 3 / (8 + (d / t) ** 3) AS s FROM d2 JOIN t USING (label))
SELECT id::VARCHAR AS asset_ref, round(s, 6) AS score, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN s >= 0.8 THEN 'quarantine' WHEN s >= 0.5 THEN 'review' ELSE 'accept' END AS disposition, 'This image is ' || printf('%.2f', r) || ' times as far from the centre of class ''' || label || ''' as its typical images.' AS reason FROM f""")
def ood_findings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"), "embedding")
    return detectors.ood(e).select("asset_ref", *_r("score"), "severity", "disposition", "reason")


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id AS id, v FROM e UNION ALL SELECT vec_id + 1000000, list_transform(v, lambda x, i: CASE WHEN i = vec_id % 64 + 1 THEN x + 0.02 ELSE x END) FROM e WHERE vec_id % 5 = 0),
n AS (SELECT id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM u),
p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS s FROM n a JOIN n b ON a.id < b.id)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.99
""")
def close_pairs_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a cosine of 0.99: the table has none, so every fifth vector has a near copy planted."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("v"))
    moved = F.transform("v", lambda x, i: F.when(i == F.pmod("id", F.lit(64)), x + 0.02).otherwise(x))
    u = e.unionByName(e.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), moved.alias("v")))
    return detectors.close_pairs(u.select("id", normalized(F.col("v")).alias("u"))).select("a", "b", *_r("similarity"))


@query("""
WITH u AS (SELECT doc_id, lang, ('0x' || substr(md5('split|' || doc_id), 1, 13))::BIGINT AS u FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM u)
SELECT doc_id, CASE WHEN r <= floor(0.4 * n + 0.5) THEN 'fit' WHEN r <= floor(0.4 * n + 0.5) + floor(0.3 * n + 0.5) THEN 'calibrate' ELSE 'test' END AS split FROM r
""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return scoring.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    y = table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).cast("int").alias("is_poisoned"))
    return y.join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("sample_id"), "is_poisoned", F.when(F.col("is_poisoned") == 1, "label_flip").alias("attack_class"), F.col("source").alias("contributor_id"))


@query(_FINDINGS + """, t AS (SELECT l.doc_id::VARCHAR AS ref, any_value(1 - quality) AS y, any_value(source) AS g FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY l.doc_id),
k AS (SELECT DISTINCT asset_ref FROM f WHERE asset_type = 'sample' AND disposition <> 'accept'),
c AS (SELECT g, count(*) AS n, count(k.asset_ref) AS k, avg(y) AS rate FROM t LEFT JOIN k ON k.asset_ref = t.ref GROUP BY g),
j AS (SELECT g, n, k, unnest(range(0, k + 1)) AS j FROM c),
l AS (SELECT g, n, k, j, (n + 1) * ln(cast(0.95 AS double)) + sum(CASE WHEN j = 0 THEN 0 ELSE ln((n + 2 - j) / j) + ln(cast(0.05 AS double)) - ln(cast(0.95 AS double)) END) OVER (PARTITION BY g ORDER BY j) AS l FROM j),
p AS (SELECT g, least(1.0, sum(exp(l))) AS p FROM l GROUP BY g),
d AS (SELECT c.g, n, k, rate, p, CASE WHEN p > 0.9 AND n >= 30 THEN 'quarantine' WHEN p > 0.6 THEN 'review' ELSE 'accept' END AS disposition FROM c JOIN p ON c.g = p.g)
SELECT g AS contributor, n AS n_samples, k AS n_flagged, round(k / n, 6) AS flagged_rate, round(p, 6) AS p_above, round(rate, 6) AS true_poison_rate, disposition, (rate > 0.05) = (disposition <> 'accept') AS matches_truth FROM d""")
def table_contributors(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.table_contributors(_findings(spark, d), _truth(spark, d))
    return t.select("contributor", "n_samples", "n_flagged", *_r("flagged_rate", "p_above", "true_poison_rate"), "disposition", "matches_truth")


@query("SELECT l_linestatus AS attack_class, count(*) AS attempts, count(*) FILTER (l_quantity > 20) AS detected, round(count(*) FILTER (l_quantity > 20) / count(*), 6) AS rate, count(*) FILTER (l_returnflag = 'R') AS named, array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') AS codes FROM lineitem GROUP BY 1")
def table_tamper(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("attack_class"), (F.col("l_quantity") > 20).alias("detected"), (F.col("l_returnflag") == "R").alias("correct_code"), F.array("l_returnflag").alias("codes"))
    return scoring.table_tamper(li).select("attack_class", "attempts", "detected", *_r("rate"), "named", "codes")


@query(_FINDINGS + "SELECT asset_ref, asset_type, attack_class, detector_id, score, disposition, CASE WHEN odd THEN 'jargon,no_number' ELSE '' END AS violations FROM f UNION ALL SELECT 'm1', 'model', 'model_substitute', 'fingerprint', 0, 'accept', ''")
def findings_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as canonical lines in the order of their assets and read again, with the rules that each breaks."""
    from attestry.sources import records

    path = shared_path(spark, "lines")
    records.write_lines(_findings(spark, d), path, ["asset_ref", "detector_id"])
    return records.read_findings(spark, path).select("asset_ref", "asset_type", "attack_class", "detector_id", "score", "disposition", F.array_join("violations", ",").alias("violations"))


@query("""
WITH s AS (SELECT DISTINCT doc_id::VARCHAR AS sample_id, lang FROM documents), a AS (SELECT * FROM s WHERE lang IS NOT NULL ORDER BY md5('flip|' || sample_id), sample_id LIMIT 40),
b AS (SELECT * FROM s WHERE lang = 'en' AND sample_id NOT IN (SELECT sample_id FROM a) ORDER BY md5('system|' || sample_id), sample_id LIMIT 30)
SELECT sample_id, lang AS true_label, 'label_flip' AS attack_class FROM a UNION ALL SELECT sample_id, lang, 'systematic_mislabel' FROM b
""")
def attack_victims(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("label"), F.lit("C0").alias("contributor_id")).distinct()
    t = attacks.systematic_mislabel(attacks.label_flip(attacks.clean_truth(s), 40, ["de", "en", "es", "fr"]), 30, "en", "fr")
    return t.where("is_poisoned = 1 and stored_label <> true_label").select("sample_id", "true_label", "attack_class")


@query()
def ks_p_value(spark: SparkSession, d: str) -> DataFrame:
    return shift.with_p_value(shift.ks_statistic(_measures(spark, d))).select("measure", *_r("d", "p"), "n_reference", "n_observed")


@query(_NEAR.replace(" WHERE a.vec_id % 50 = 0", "") + """, c AS (SELECT id, any_value(label) AS label, l, count(*) AS n, min(rank) AS r FROM n GROUP BY id, l),
m AS (SELECT id, label, l AS majority, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, r) = 1),
g AS (SELECT m.*, coalesce((SELECT n FROM c WHERE c.id = m.id AND c.l = m.label), 0) / 20 AS agreement FROM m), s AS (SELECT *, (1 - agreement) * n / 20 AS s FROM g)
SELECT id::VARCHAR AS asset_ref, round(s, 6) AS score, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN s >= 0.8 THEN 'quarantine' WHEN s >= 0.5 THEN 'review' ELSE 'accept' END AS disposition FROM s""")
def label_noise_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every sample against all others, in blocks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"), "embedding")
    return detectors.label_noise(e).select("asset_ref", *_r("score"), "severity", "disposition")
