"""Entry points for spark-submit: an analysis, a clustering run and a brief over tables in Parquet folders.

    spark-submit weft/jobs.py analysis --tables T --out O
    spark-submit weft/jobs.py dedup --tables T --out O --as-of 2026-08-01
    spark-submit weft/jobs.py brief --tables T --out O --as-of 2026-08-01T06:00:00 --dry-run

Tables are read from T/<name>, results written to O/<name>; each job prints its counters.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import scoring
from weft.operators import digest, ingest, similarity
from weft.operators.lineage import cut


def _moment(value: str):
    return F.to_timestamp_ntz(F.lit(value))


def analysis(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """routes (id, status, gate) of judged documents (id, content, passed, gate_failed, gate_score, confidence), and counters by status."""
    d = tables["judged"]
    status = scoring.gate_status(F.col("passed"), F.col("gate_failed"), F.col("content"), F.col("confidence"))
    routes = cut(d.select("id", status.alias("status"), scoring.gate_score(F.col("gate_score"), F.col("gate_failed")).alias("gate")))
    return {"routes": routes, "counters": ingest.status_counts(routes)}


def dedup(tables: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """clusters of the published items (id, text, status, created_at, trust_tier, published_at, confidence) of the last days, and counters."""
    taken = similarity.recent(tables["items"], _moment(as_of))
    marked = cut(similarity.dedup(taken.select("id", "text", "trust_tier", "published_at", "confidence"), _moment(as_of)))
    return {"clusters": marked, "counters": similarity.counters(marked)}


def brief(tables: dict[str, DataFrame], as_of: str, force: bool = False, results: DataFrame | None = None) -> dict[str, DataFrame]:
    """digests of subscribers over items and deliveries, and, where results (subscriber, ok) of sending are given, the new log rows and counters.

    Without results it is a dry run: nothing is logged.
    """
    people, log = tables["subscribers"], tables["deliveries"]
    chosen = cut(digest.brief(people, tables["items"], log, _moment(as_of), force=force))
    if results is None:
        return {"digests": chosen}
    return {"digests": chosen, "log": digest.logged(log, chosen, results, "brief", _moment(as_of)), "counters": digest.run_counts(people, chosen, results)}


NEEDS = {"analysis": ["judged"], "dedup": ["items"], "brief": ["subscribers", "items", "deliveries"]}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weft.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = out.add_subparsers(dest="job", required=True)
    for name in NEEDS:
        job = jobs.add_parser(name)
        job.add_argument("--tables", required=True)
        job.add_argument("--out", required=True)
        if name != "analysis":
            job.add_argument("--as-of", required=True)
        if name == "brief":
            how = job.add_mutually_exclusive_group(required=True)
            how.add_argument("--dry-run", action="store_true", help="digests only, nothing logged")
            how.add_argument("--results", help="table (subscriber, ok) of what was sent")
            job.add_argument("--force", action="store_true", help="without the cool-down")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """Run the job that the arguments name and write what it returns."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"weft {a.job}").getOrCreate()
    read = lambda name: spark.read.parquet(f"{a.tables}/{name}")
    tables = {name: read(name) for name in NEEDS[a.job]}
    if a.job == "analysis":
        done = analysis(tables)
    elif a.job == "dedup":
        done = dedup(tables, a.as_of)
    else:
        done = brief(tables, a.as_of, a.force, read(a.results) if a.results else None)
    for name, df in done.items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    if "counters" in done:
        print([r.asDict() for r in spark.read.parquet(f"{a.out}/counters").collect()])
    return done


if __name__ == "__main__":
    main()
