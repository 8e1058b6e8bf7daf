"""Command line: scan, filter, explain, doctor, config.

    spark-submit -m piispan filter --input docs.parquet --output out.parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from piispan.plans import api
from piispan.sources import config


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="piispan", description=__doc__)
    p.add_argument("command", choices=["scan", "filter", "explain", "doctor", "config"])
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--config")
    p.add_argument("--native", action="store_true")
    a = p.parse_args(argv)
    settings = config.load(a.config) if a.config else config.Settings()
    if a.command == "config":
        print(settings)
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "doctor":
        print(api.health(spark))
        api.canary(spark).show(truncate=False)
        return
    docs = spark.read.parquet(a.input)
    out = {"scan": lambda: api.scan(docs, settings, native=a.native), "filter": lambda: api.filter_documents(docs, settings, native=a.native), "explain": lambda: api.explain(docs, settings.options())}[a.command]()
    out.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
