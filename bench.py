"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers

HEADLINE = ["html_links", "html_titles", "html_paragraphs", "pattern_items", "xpath_child_predicate", "xpath_positions", "xpath_count_sum", "identity_unique", "serialize_orders", "canonical_digest", "schematron_events", "item_corpus_count"]


def item_corpus(spark, n_docs: int = 10_000, items: int = 20):
    """Documents of the item schema: each about 4 kB."""
    from pyspark.sql import functions as F

    i = F.col("doc_id") * items
    one = lambda k: F.concat(F.lit('<item id="i'), (i + k).cast("string"), F.lit('" kind="'), F.when((i + k) % 2 == 0, "even").otherwise("odd"), F.lit('" rank="'), ((i + k) % 97).cast("string"), F.lit('"><name>Item &amp; name '), (i + k).cast("string"), F.lit('</name><price currency="EUR">'), ((i + k) * 37 % 1000).cast("string"), F.lit('.00</price><note xml:space="preserve"> some  note text of an item </note></item>'))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(items - 1)), one), "")
    return spark.range(n_docs).select(F.col("id").alias("doc_id")).select("doc_id", F.concat(F.lit("<catalog>"), body, F.lit("</catalog>")).alias("xml"))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from treeframe.queries import QUERIES
    from treeframe.sources import shred
    from treeframe.xpath import select

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def count_items(s, d):
        nodes = shred.read_xml(item_corpus(s).repartition(int(cpus) * 2), columns=["pre", "kind", "prefix", "local", "ns", "attrs", "path"])
        return select(nodes, "//item[@kind='even']").groupBy("doc_id").agg(F.count("*").alias("n"))

    runs = QUERIES | {"item_corpus_count": count_items}
    QUERIES["html_links"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers
    times = {}
    for name in HEADLINE:
        began = time.time()
        runs[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
