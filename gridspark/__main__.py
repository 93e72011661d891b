"""python -m gridspark [-s] DATASET...: what is in datasets, all of it or, with -s, a line a field."""

import sys

from pyspark.sql import SparkSession

from .io import read
from .plans.report import dump, one_line


def main(arguments: list[str]) -> int:
    short = "-s" in arguments
    patterns = [x for x in arguments if x != "-s"]
    if not patterns:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    for f in read(spark, *patterns):
        print(one_line(f) if short else dump(f) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
