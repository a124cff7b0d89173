"""Command line: python -m chronomill [--store FOLDER] COMMAND ..., its rows as JSON lines.

ingest PATH [--url URL] [--language NAME] [--compat]; file PATH [--language NAME] [--report] [--ignore FILE] [--together];
serve [--host HOST] [--port PORT] for the same over HTTP; and the queries of ``plans.api`` by name with their arguments, for example ``current_files VERSION`` or ``search_functions VERSION QUERY``.
"""

from __future__ import annotations

import argparse
import inspect


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators.reports import file_report
    from .plans.api import Queries
    from .plans.catalog import Catalog
    from .plans.ingest import ingest

    p = argparse.ArgumentParser(prog="chronomill", description=__doc__)
    p.add_argument("--store", default="spark-warehouse/history")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("path")
    one.add_argument("--url")
    one.add_argument("--language")
    one.add_argument("--compat", action="store_true")
    one = sub.add_parser("file")
    one.add_argument("path")
    one.add_argument("--language")
    one.add_argument("--compat", action="store_true")
    one.add_argument("--report", action="store_true")
    one.add_argument("--ignore", help="a file of ignore rules, relative to its folder")
    one.add_argument("--together", action="store_true")
    one = sub.add_parser("serve")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=8080)
    for name, f in inspect.getmembers(Queries, inspect.isfunction):
        if name.startswith("_") or name in ("health", "analyse_file"):
            continue
        one = sub.add_parser(name, help=inspect.getdoc(f))
        for x in list(inspect.signature(f).parameters.values())[1:]:
            number = x.name in ("limit", "offset")
            if x.default is inspect.Parameter.empty:
                one.add_argument(x.name)
            elif x.default is False:
                one.add_argument(f"--{x.name}", action="store_true")
            else:
                one.add_argument(f"--{x.name}", type=int if number else str, default=x.default)
    a = vars(p.parse_args(argv))
    command, store = a.pop("command"), a.pop("store")
    spark = SparkSession.builder.appName("chronomill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog.open(spark, store)
    if command == "ingest":
        print(ingest(catalog, **a))
        return
    if command == "serve":
        from .plans.web import serve

        serve(catalog, **a)
        return
    if command == "file":
        report = a.pop("report")
        rows = Queries(catalog).analyse_file(**a)
        if report:
            for r in file_report(rows).toLocalIterator():
                print(r["report"])
            return
        rows = rows.drop("text", "tokens")
    else:
        rows = getattr(Queries(catalog), command)(**a)
    for line in rows.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
