"""Command line: python -m attestry audit ROOT OUT | verify LOG KEYS | score FINDINGS TRUTH OUT | inspect ROOT. Exit code 0 if all is well, else 2 (audit) or 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="attestry")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("audit")
    a.add_argument("root")
    a.add_argument("out")
    a.add_argument("--layout")
    a.add_argument("--contributors")
    a.add_argument("--pattern")
    i = verbs.add_parser("inspect")
    i.add_argument("root")
    v = verbs.add_parser("verify")
    v.add_argument("log")
    v.add_argument("keys", help="JSON lines with actor_id and key, in hexadecimal")
    s = verbs.add_parser("score")
    s.add_argument("findings")
    s.add_argument("truth")
    s.add_argument("out")
    args = p.parse_args(argv)

    from attestry.operators import audit as audits
    from attestry.operators import custody, scoring
    from attestry.session import local_session, ship
    from attestry.sources import datasets, records

    spark = local_session()
    ship(spark)
    if args.verb == "inspect":
        d = datasets.load_dataset(spark, args.root)
        print(d.layout, *d.limitations, sep="\n")
        d.samples.agg(F.count("*").alias("samples"), F.count_distinct("label").alias("labels"), F.count_distinct("contributor_id").alias("contributors")).show()
        return 0
    if args.verb == "audit":
        d = datasets.load_dataset(spark, args.root, args.layout, args.contributors, args.pattern)
        found = audits.audit(spark, d)
        records.write_lines(found.findings, f"{args.out}/findings", ["asset_ref", "detector_id"])
        records.write_table(found.coverage(), f"{args.out}/coverage")
        verdict = found.verdict().first()
        print(verdict.asDict())
        return 0 if verdict["verdict"] == "green" else 2
    if args.verb == "verify":
        log = records.read_log(spark, args.log, "seq long, prev_hash string, record_hash string, nonce string, ts string, actor_id string, signature string").withColumn("signature", F.try_to_binary("signature", F.lit("hex")))
        keys = spark.read.schema("actor_id string, key string").json(args.keys).withColumn("key", F.unhex("key"))
        bad = custody.headlines(custody.verify_receipts(log, keys))
        bad.orderBy("chain", "idx").show(50, truncate=False)
        return int(bad.limit(1).count() > 0)
    for name, table in scoring.score_all(records.read_findings(spark, args.findings).drop("violations"), records.read_truth(spark, args.truth)).items():
        records.write_table(table, f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
