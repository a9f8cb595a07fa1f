"""Matrix files: row-major text, coordinate exchange files and compressed JSON, read and written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import COMPLEX, INTEGER, REAL, TYPES, ScalarType, guess_column
from ..matrix import Matrix
from ..plans.quadtree import QUADS, NodeTable, compress, expand
from ..plans.staging import cut


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n and s: the lines of files, read in as many tasks as there are splits. Lines are in the order of the
    split's place in its file, and of n within the split."""
    at = F.col("_metadata")
    return spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("s"))


def read_row_major(spark: SparkSession, path: str, stype: ScalarType | None = None) -> Matrix:
    """``row_level col_level`` and then all values, row by row, between blanks of any kind.

    Places are running sums of values a line: within splits, and over splits, of which there is a row each."""
    lines = lines_of(spark, path).select("block", "n", F.filter(F.split("s", r"\s+"), lambda t: t != "").alias("t"))
    lines = cut(lines.where(F.size("t") > 0))
    before = lambda w, k: F.coalesce(F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("block").agg(F.sum(F.size("t")).alias("k"))
    total = blocks.agg(F.sum("k")).first()[0] or 0
    base = blocks.select("block", before(Window.orderBy("block"), "k").alias("base"))
    placed = lines.withColumn("first", before(Window.partitionBy("block").orderBy("n"), F.size("t"))).join(base, "block")
    tokens = placed.select((F.col("base") + F.col("first")).alias("first"), F.posexplode("t").alias("p", "s")).select((F.col("first") + F.col("p")).alias("id"), "s")
    head = {x["id"]: int(x["s"]) for x in tokens.where("id < 2").collect()}
    if len(head) < 2:
        raise ValueError("the file has no levels")
    r, c = head[0], head[1]
    if total - 2 < 1 << (r + c):
        raise ValueError(f"{total - 2} values for {1 << (r + c)} cells")
    cell = tokens.where((F.col("id") >= 2) & (F.col("id") < 2 + (1 << (r + c))))
    stype = stype or guess_column(cell, F.col("s"))
    at = F.col("id").cast("long") - 2
    df = cell.select(F.shiftright(at, c).alias("row"), at.bitwiseAND(F.lit((1 << c) - 1).cast("long")).alias("col"), stype.parse(F.col("s")).alias("val"))
    return Matrix(df.where(stype.nonzero(F.col("val"))), r, c, stype)


FIELDS = {"integer": INTEGER, "real": REAL, "double": REAL, "complex": COMPLEX, "pattern": INTEGER}


def read_coordinates(spark: SparkSession, path: str, stype: ScalarType | None = None) -> Matrix:
    """A Matrix Market coordinate file. The result is square: both levels are those of the longer side. Entries that
    repeat are summed; the mirror images of a symmetric file leave out the diagonal."""
    lines = lines_of(spark, path).select(F.struct("block", "n").alias("n"), F.trim("s").alias("s"))
    first = lines.orderBy("n").first()
    banner = (first["s"] if first else "").lower().split()
    if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[1:3] != ["matrix", "coordinate"] or banner[3] not in FIELDS or banner[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"no coordinate file: {' '.join(banner)[:80]}")
    kind, symmetry = banner[3:5]
    body = lines.where("s <> '' AND s NOT LIKE '\\\\%%'")
    head = body.orderBy("n").first()
    rows, cols, count = (int(x) for x in head["s"].split())
    level = max((max(rows, cols) - 1).bit_length(), 0)
    stype = stype or FIELDS[kind]
    p = F.split("s", r"\s+")
    value = F.lit("1") if kind == "pattern" else F.concat(p[2], F.when(F.startswith(p[3], F.lit("-")), F.concat(F.lit("-I*"), F.substring(p[3], F.lit(2), F.length(p[3])))).otherwise(F.concat(F.lit("+I*"), p[3]))) if kind == "complex" else p[2]
    cell = body.where(F.col("n") > F.struct(F.lit(head["n"][0]).alias("block"), F.lit(head["n"][1]).alias("n"))).select((p[0].cast("long") - 1).alias("row"), (p[1].cast("long") - 1).alias("col"), stype.parse(value).alias("val"))
    found = cell.count()
    if found != count:
        raise ValueError(f"{found} entries, {count} announced")
    if symmetry != "general":
        v = F.col("val")
        mirror = cell.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), {"symmetric": v, "skew-symmetric": stype.minus(v), "hermitian": stype.conj(v)}[symmetry].alias("val"))
        cell = cell.unionByName(mirror)
    return Matrix(stype.sum_by(cell, ["row", "col"]), level, level, stype)


ENTRY = r'^\s*"([0-9]+)"\s*:\s*(\[[^\[\]]*\])\s*,?\s*$'
HEAD_BYTES = 1 << 20  # what stands around the table's entries, if each of those has a line of its own


def read_nodes(spark: SparkSession, path: str, stype: ScalarType | None = None) -> tuple[NodeTable, dict[str, str]]:
    """A compressed JSON file, or a folder of its parts, with scalars as strings or, in old files, as numbers.

    Entries of the table that have a line each, as writers give them, are read line by line, in many tasks and at any size.
    Any other layout is parsed whole, file by file."""
    head = rows = None
    lines = lines_of(spark, path).where("trim(s) <> ''")
    rest = lines.where(~F.col("s").rlike(ENTRY))
    if (rest.agg(F.sum(F.length("s"))).first()[0] or 0) <= HEAD_BYTES:
        kept = [x["s"] for x in rest.orderBy("file", "block", "n").collect()]
        try:
            head = json.loads("\n".join(kept))
            if not {"matid", "table"} <= set(head) or set(head["table"]) - {"end"}:
                head = None  # a table that is not written line by line
        except ValueError:
            head = None
    if head:
        matid, info = head["matid"], head.get("info") or {}
        rows = lines.where(F.col("s").rlike(ENTRY)).select(F.regexp_extract("s", ENTRY, 1).alias("id"), F.from_json(F.regexp_extract("s", ENTRY, 2), "array<string>").alias("v"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "matid BIGINT, info MAP<STRING,STRING>, table MAP<STRING,STRING>").alias("x")).select("x.*")
        first = whole.select("matid", "info").first()
        matid, info = first["matid"], first["info"] or {}
        rows = whole.select(F.explode("table").alias("id", "v")).where("id <> 'end'").select("id", F.from_json("v", "array<string>").alias("v"))
    leaf = (F.col("v")[0] == "0") & (F.col("v")[1] == "0")
    im = F.try_element_at("v", F.lit(4))
    text = F.when(im.isNull(), F.col("v")[2]).otherwise(F.concat(F.col("v")[2], F.when(F.startswith(im, F.lit("-")), F.concat(F.lit("-I*"), F.substring(im, F.lit(2), F.length(im)))).otherwise(F.concat(F.lit("+I*"), im))))
    quad = lambda k: F.when(~leaf, F.nullif(F.try_element_at("v", F.lit(3 + k)), F.lit("-1"))).alias(f"q{k}")
    nodes = cut(rows.select("id", F.col("v")[0].cast("int").alias("row_level"), F.col("v")[1].cast("int").alias("col_level"), *(quad(k) for k in range(4)), F.when(leaf, text).alias("scalar")))
    info = {k: v for k, v in info.items() if k != "end"}
    if stype is None:
        named = TYPES.get(info.get("SCALARTYPE", "").upper())
        stype = named or guess_column(nodes.where("scalar IS NOT NULL"), F.col("scalar"))
    root = str(matid)
    top = nodes.where(F.col("id") == root).first()
    if top is None:
        raise ValueError("the file has no root")
    return NodeTable(nodes, root, top["row_level"], top["col_level"], stype, canonical=False), info


def read_json(spark: SparkSession, path: str, stype: ScalarType | None = None) -> Matrix:
    nt, info = read_nodes(spark, path, stype)
    m = expand(nt)
    return Matrix(m.df, m.row_level, m.col_level, m.stype, info)


def levels(spark: SparkSession, path: str) -> tuple[int, int]:
    nt, _ = read_nodes(spark, path)
    return nt.row_level, nt.col_level


def scalar_type(spark: SparkSession, path: str) -> str:
    return read_nodes(spark, path)[0].stype.name


def _put(lines: DataFrame, path: str, parts: bool = False) -> None:
    """Writes the lines, in their order: as a folder of part files, each by a task of its own, or as one file by way of a
    folder beside it, on any file system that Spark reaches."""
    spark = lines.sparkSession
    if parts:
        lines.write.mode("overwrite").text(path)
        return
    lines.coalesce(1).write.mode("overwrite").text(path + ".parts")
    jvm = spark._jvm
    src = jvm.org.apache.hadoop.fs.Path(path + ".parts")
    store = src.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(src) if f.getPath().getName().startswith("part-"))
    dst = jvm.org.apache.hadoop.fs.Path(path)
    store.delete(dst, True)
    store.rename(part, dst)
    store.delete(src, True)


def write_nodes(nt: NodeTable, path: str, info: dict[str, str] | None = None, top_left: bool = False, parts: bool = False) -> int:
    """Writes a table of blocks, children before parents; gives their number. With top_left blocks come in the order of their
    first place in the matrix, from the root down, found by following quadrants. With parts the path is a folder of files,
    which ``read_nodes`` reads like one."""
    height = F.greatest("row_level", "col_level")
    nodes, spark = cut(nt.nodes.withColumn("h", height)), nt.spark
    if top_left:
        front = seen = spark.createDataFrame([(nt.root, "")], "id string, place string")
        kids = nodes.where("scalar IS NULL").select("id", F.posexplode(F.array(*QUADS)).alias("q", "kid")).where("kid IS NOT NULL")
        for _ in range(max(nt.row_level, nt.col_level)):
            front = cut(front.join(kids, "id").groupBy(F.col("kid").alias("id")).agg(F.min(F.concat("place", F.col("q").cast("string"))).alias("place")))
            seen = seen.unionByName(front)
        nodes = nodes.join(seen.groupBy("id").agg(F.min("place").alias("place")), "id")
        order = [F.desc("h"), "place", "id"]
    else:
        order = ["h", "id"]
    # a sorted table's partitions are in order, so that their row ids are numbers in that order
    ids = cut(nodes.orderBy(*order).select(F.monotonically_increasing_id().alias("n"), "id", "h", "row_level", "col_level", *QUADS, "scalar"))
    short = ids.select("id", "n")
    out = ids
    for q in QUADS:
        out = out.join(short.select(F.col("id").alias(q), F.col("n").alias(f"n_{q}")), q, "left")
    number = lambda q: F.coalesce(F.col(f"n_{q}").cast("string"), F.lit("-1"))
    quads = F.concat_ws(", ", *(number(q) for q in QUADS))
    what = F.when(F.col("scalar").isNotNull(), F.concat(F.lit('"'), "scalar", F.lit('"'))).otherwise(quads)
    line = F.format_string('    "%d":[%d, %d, %s],', F.col("n"), F.col("row_level"), F.col("col_level"), what)
    size, scalars, most = ids.agg(F.count(F.lit(1)), F.count("scalar"), F.max("n")).first()
    root = ids.where(F.col("id") == nt.root).first()["n"]
    info = {**(info or {}), "SCALARTYPE": nt.stype.name, "NODES": str(size), "UNIQ_SCALARS": str(scalars), "end": ""}
    body = out.select(F.lit(1).alias("part"), "n", line.alias("value"))
    ends = spark.createDataFrame([(0, 0, f'{{"matrixID_max":{most + 1},\n  "matid":{root},\n  "info":{json.dumps(info)},\n  "table":{{'), (2, 0, '    "end":0 }\n}')], "part int, n bigint, value string")
    _put(ends.unionByName(body).orderBy("part", "n").select("value"), path, parts)
    return size


def write_json(m: Matrix, path: str, top_left: bool = False, parts: bool = False) -> int:
    """``write_nodes`` of a matrix's compressed form."""
    return write_nodes(compress(m), path, m.info, top_left, parts)


def equal_files(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two compressed files hold the same matrix; blocks are named anew, and nothing is expanded."""
    return read_nodes(spark, one)[0].same(read_nodes(spark, other)[0])


def dense_text(m: Matrix) -> DataFrame:
    """row and line: the values of a row between blanks. Only for small matrices."""
    most = 10 if m.stype in (INTEGER, REAL) else 7 if m.stype is COMPLEX else 6
    if max(m.row_level, m.col_level) > most:
        raise ValueError(f"levels over {most} are not written out")
    text = m.dense().select("row", F.struct("col", m.stype.text(F.col("val")).alias("t")).alias("x"))
    return text.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("line")).orderBy("row")


def write_dense(m: Matrix, path: str) -> None:
    _put(dense_text(m).select("line"), path)


def write_nonzeros(m: Matrix, path: str) -> None:
    """value, a tab and (row,col), by row and column."""
    line = F.concat(m.stype.text(F.col("val")), F.lit("\t("), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"), F.lit(")"))
    _put(m.df.orderBy("row", "col").select(line), path)


def write_scalars(m: Matrix, path: str) -> int:
    """The different scalars, a line each: real and imaginary part of complex ones, else the value. Beside it ``path.info``
    has what is known of the matrix, a name and a text a line."""
    got = m.scalars()
    line = F.concat_ws(" ", F.col("val.re").cast("string"), F.col("val.im").cast("string")) if m.stype is COMPLEX else m.stype.text(F.col("val"))
    lines = cut(got.select(line.alias("value")).orderBy("value"))
    n = lines.count()
    _put(lines, path)
    info = {**m.info, "SCALARTYPE": m.stype.name, "ROW_LEVEL": str(m.row_level), "COL_LEVEL": str(m.col_level), "UNIQ_SCALARS": str(n)}
    _put(m.spark.createDataFrame([(f"{k}\t{v}",) for k, v in info.items()], "value string").coalesce(1), path + ".info")
    return n


def write_coordinates(m: Matrix, path: str) -> None:
    """A Matrix Market coordinate file of a matrix of integers, reals or complex numbers."""
    if m.stype not in (INTEGER, REAL, COMPLEX):
        raise ValueError("only integers, reals and complex numbers have such files")
    value = F.concat_ws(" ", F.col("val.re").cast("string"), F.col("val.im").cast("string")) if m.stype is COMPLEX else m.stype.text(F.col("val"))
    body = m.df.select(F.lit(1).alias("part"), "row", "col", F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), value).alias("value"))
    head = f"%%MatrixMarket matrix coordinate {m.stype.name.lower()} general\n{1 << m.row_level} {1 << m.col_level} {m.df.count()}"
    first = m.spark.createDataFrame([(0, 0, 0, head)], "part int, row bigint, col bigint, value string")
    _put(first.unionByName(body).orderBy("part", "row", "col").select("value"), path)


def write_row_major(m: Matrix, path: str) -> None:
    lines = dense_text(m).select((F.col("row") + 1).alias("row"), F.col("line").alias("value"))
    head = m.spark.createDataFrame([(0, f"{m.row_level} {m.col_level}")], "row bigint, value string")
    _put(head.unionByName(lines).orderBy("row").select("value"), path)


