"""Commands on matrix files: python -m quadlake.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import TYPES
from .matrix import morton
from .plans.quadtree import canonical
from .sources import build, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"count": ["file", "scalar"], "locate": ["file", "scalar"], "equal": ["file", "other"], "print": ["file"], "canonical": ["file", "out"], "from-coordinates": ["file", "out"], "from-rows": ["file", "out"]}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "locate":
            c.add_argument("--most", type=int, default=1000)
    c = sub.add_parser("random")
    c.add_argument("out")
    for a in ("row_level", "col_level"):
        c.add_argument(a, type=int)
    c.add_argument("--low", type=int, default=-100)
    c.add_argument("--high", type=int, default=100)
    c.add_argument("--sparsity", type=float, default=0.0)
    c.add_argument("--ones", type=int)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--type", choices=sorted(TYPES), default="INTEGER")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "count":
        nt, _ = files.read_nodes(spark, a.file)
        print(nt.count(a.scalar).first()[0])  # from counts of blocks, however large the matrix is
    elif a.command == "locate":
        nt, _ = files.read_nodes(spark, a.file)
        order = morton(F.col("row"), F.col("col"), nt.row_level, nt.col_level)
        for r in nt.locate(a.scalar, a.most).orderBy(order).toLocalIterator():
            print(r["row"], r["col"])
    elif a.command == "equal":
        same = files.equal_files(spark, a.file, a.other)
        print("equal" if same else "different")
        return int(not same)
    elif a.command == "print":
        for r in files.dense_text(files.read_json(spark, a.file)).toLocalIterator():
            print(r["line"])
    elif a.command == "canonical":
        nt, info = files.read_nodes(spark, a.file)
        print(files.write_nodes(canonical(nt), a.out, info))
    elif a.command in ("from-coordinates", "from-rows"):
        read = {"from-coordinates": files.read_coordinates, "from-rows": files.read_row_major}[a.command]
        print(files.write_json(read(spark, a.file), a.out))
    else:
        t = TYPES[a.type]
        m = build.random_ones(spark, a.row_level, a.col_level, a.ones, a.seed, t) if a.ones is not None else build.random_entries(spark, a.row_level, a.col_level, a.low, a.high, a.sparsity, a.seed, t)
        print(files.write_json(m, a.out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
