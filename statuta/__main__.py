"""python -m statuta ingest PAGES CHUNKS | compare RUNS SPLIT TAG... | query NAME TABLES OUT"""

from __future__ import annotations

import argparse

from statuta.operators import metrics
from statuta.plans import catalog, search
from statuta.runtime import make_session
from statuta.sources import pages, tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    ingest = sub.add_parser("ingest", help="page texts, parted by form feeds, into a collection of chunks")
    ingest.add_argument("pages")
    ingest.add_argument("chunks")
    ingest.add_argument("--fixed", action="store_true", help="windows of words instead of units")
    compare = sub.add_parser("compare", help="the summaries of saved runs side by side")
    compare.add_argument("runs")
    compare.add_argument("split")
    compare.add_argument("tags", nargs="+")
    query = sub.add_parser("query", help="a query of the catalog, written as parquet")
    query.add_argument("name", choices=catalog.NAMES)
    query.add_argument("tables")
    query.add_argument("out")
    a = p.parse_args(args)
    spark = make_session()
    if a.what == "ingest":
        tables.write_chunks(search.ingest(pages.read_texts(spark, a.pages), fixed=a.fixed), a.chunks)
    elif a.what == "compare":
        metrics.compare(tables.read_runs(spark, a.runs, a.tags, a.split, "summary"), a.tags).show(50, truncate=False)
    else:
        catalog.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
