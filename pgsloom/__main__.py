"""Command line: ``python -m pgsloom`` with ``list``, ``query``, ``etl``, ``import``, ``score``, ``traits``, ``pgs``, ``pending``, ``forget`` or ``report``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pgsloom import engine, queries
from pgsloom.sources import scoring_files, tables

#: Arguments of each command, and what may be given besides (lists by comma).
COMMANDS = {
    "list": ([], []), "query": (["name", "folder"], []), "etl": (["files", "out"], []), "import": (["root", "file", "individual"], []), "score": (["root"], ["people", "traits"]),
    "traits": (["root"], ["individual", "search", "category", "state"]), "pgs": (["root"], ["trait"]), "pending": (["root"], []), "forget": (["root", "people"], []), "report": (["root"], []),
}


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pgsloom")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for name, (arguments, options) in COMMANDS.items():
        sub = kinds.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        for o in options:
            sub.add_argument(f"--{o}")
    told = parser.parse_args(words)
    if told.kind == "list":
        print("\n".join(queries.QUERIES))
        return
    spark = SparkSession.builder.appName("pgsloom").getOrCreate()
    listed = lambda text: text.split(",") if text else None
    if told.kind == "query":
        queries.QUERIES[told.name](spark, told.folder).show(50, False)
        return
    if told.kind == "etl":
        tables.write_pack(scoring_files.read_scores(spark, told.files), told.out)
        return
    own = engine.Engine(spark, told.root)
    if told.kind == "import":
        print(own.import_dna(told.file, told.individual).count())
    elif told.kind == "score":
        print(own.calculate(listed(told.people), listed(told.traits))[1].count())
    elif told.kind == "traits":
        own.dashboard(told.individual or "", search=told.search or "", category=told.category or "", state=told.state or "").orderBy("place").show(1000, False)
    elif told.kind == "pgs":
        scores = own.scores()
        (scores.filter(F.col("trait_id") == told.trait) if told.trait else scores).orderBy("trait_id", "pgs_id").show(1000, False)
    elif told.kind == "pending":
        own.pending().orderBy("individual_id", "trait_id").show(1000, False)
    elif told.kind == "forget":
        own.forget(listed(told.people))
    else:
        own.summary().show(100, False)


if __name__ == "__main__":
    main()
