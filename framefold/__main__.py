"""python -m framefold --import FOLDER [--out FOLDER]: lists a folder's images and scores its PNG files.  (S5)"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framefold")
    parser.add_argument("--import", "-i", dest="folder", required=True)
    parser.add_argument("--out", "-o")
    given = parser.parse_args(args)
    folder = os.path.abspath(given.folder) if "://" not in given.folder else given.folder
    if "://" not in folder and not os.path.isdir(folder):
        print(f"{folder} is no folder", file=sys.stderr)
        return 1
    from framefold.operators.catalog import classified, scan
    from framefold.operators.kernels import regional
    from framefold.session import local_session
    from framefold.sources.images import read_png

    spark = local_session(os.cpu_count() or 2)
    files = classified(scan(spark, folder)).orderBy("path")
    scores = regional(read_png(spark, folder).withColumnRenamed("path", "file"), 4)
    rows = files.join(scores, files.path == F.col("file"), "left").select("path", "kind", "length", F.col("max_regional").alias("score")).orderBy("path")
    if given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
