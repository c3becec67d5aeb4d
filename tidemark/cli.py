"""``python -m tidemark.cli IN OUT``: the best-rated comedies of a JSON file of movies, as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sinks import write_json
from tidemark.session import cluster_session
from tidemark.sources import MOVIES, read_json


def good_comedies(movies: DataFrame, above: float = 6.5) -> DataFrame:
    """The filter uses a column that the projection leaves out; the analyzer carries it along and drops it."""
    picked = movies.select(F.col("Title"), F.col("IMDB_Rating").alias("Rating"), F.col("Release_Date").alias("Release"))
    return picked.where((F.col("Major_Genre") == "Comedy") & (F.col("IMDB_Rating") > above)).orderBy(F.col("Rating").desc_nulls_last())


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("source", help="JSON lines of movies")
    parser.add_argument("target", help="folder for the result")
    given = parser.parse_args(args)
    spark = cluster_session("good comedies")
    write_json(good_comedies(read_json(spark, given.source, MOVIES)), given.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
