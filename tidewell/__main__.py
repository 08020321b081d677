"""``python -m tidewell PROGRAM [--tables FOLDER] [--inspect]``: build a program's outputs and print them.

A ``.py`` file defines ``program(spark)``, which returns a Program.  Any other file is a program as
text, over the Parquet tables of FOLDER.  ``--inspect`` prints the plans instead.
"""

from __future__ import annotations

import argparse
import runpy
from pathlib import Path

from pyspark.sql import SparkSession

from tidewell.plans.program import Program
from tidewell.plans.text import Text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    parser.add_argument("file")
    parser.add_argument("--tables", help="a folder of Parquet tables, for programs as text")
    parser.add_argument("--inspect", action="store_true", help="print the plans")
    parser.add_argument("--rows", type=int, default=20, help="rows to print of each output")
    known = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    if known.file.endswith(".py"):
        program = runpy.run_path(known.file)["program"](spark)
    else:
        with open(known.file) as file:
            text = file.read()
        tables = {p.stem: spark.read.parquet(str(p)) for p in Path(known.tables).glob("*.parquet")} if known.tables else {}
        program = Program(spark)
        program.output("value")(lambda p: Text(spark, **tables).run(text))
    if known.inspect:
        program.explain()
        return
    for name, df in program.build().items():
        print(f"== {name} ==")
        df.show(known.rows, truncate=False)


if __name__ == "__main__":
    main()
