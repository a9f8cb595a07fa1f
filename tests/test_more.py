"""Bounds, the registry, streams and commands."""

import pytest

from pyspark.sql import functions as F

from quadlake import cli
from quadlake.functions.bounds import LOWER, UPPER, Bounds
from quadlake.plans.registry import Registry
from quadlake.sources import build as B
from quadlake.streaming.accumulate import accumulate


def test_bounds(spark):
    up, low = Bounds(True), Bounds(False)
    for b, s, want in ((up, "0.9375", "^1"), (low, "0.9375", "vexplist[1,2,3]"), (up, "15/64", "^explist[2]"), (low, "15/64", "vexplist[3,4,5]"), (up, "explist[1,1]", "1"), (up, "2", "NaN"), (low, "1/3", "vexplist[2,4,6]"), (up, "1/3", "^explist[2,4,5]")):
        assert b.text(b.parse(s)) == want, s
    add = lambda b, x, y: b.text(b.add(b.parse(x), b.parse(y)))
    assert add(up, "explist[1]", "explist[2]") == "explist[1,2]" and add(up, "1", "explist[2]") == "NaN" and add(up, "^1", "explist[2]") == "^1"
    assert add(low, "vexplist[1]", "explist[1]") == "1" and add(low, "vexplist[1]", "explist[1,2]") == "NaN" and add(up, "^explist[1]", "explist[1,2]") == "^1"
    assert up.text(up.mul(up.parse("explist[1,2]"), up.parse("explist[3]"))) == "explist[4,5]"
    for t in (UPPER, LOWER):
        m = B.from_list(spark, ["explist[1]", "0", "0", "explist[2]"], 1, 1, t)
        assert (m @ m).at_text(0, 0) == "explist[2]" and m.trace().first()[0] == "explist[1,2]"


def test_registry(spark):
    reg, a, b = Registry(), B.identity(spark, 2), B.hadamard(spark, 2)
    s = reg.op("add", lambda x, y: x + y, a, b)
    assert reg.op("add", lambda x, y: 1 / 0, b, a) is s and reg.counts()["operations"] == 1
    reg.hold(s)
    reg.set_info(s, "DATE", "today")
    assert reg.clean() == 0 and reg.get_info(s, "DATE") == "today" and reg.get_info(a, "DATE") == ""
    with pytest.warns(UserWarning):
        reg.set_info(s, "DATE", "tomorrow")
    assert reg.info_names() == ["DATE"] and [x["held"] for x in reg.listing()] == [1] and not reg.remove(s)
    eye = reg.keep(a)
    assert reg.remove(eye) and not reg.remove(eye)
    reg.release(s)
    assert reg.clean() == 1 and reg.counts()["operations"] == 0
    with pytest.raises(ValueError):
        reg.release(s)


def test_stream(spark, tmp_path):
    events = spark.range(100).select((F.col("id") % 7).alias("user_id"), (F.col("id") % 3).alias("kind"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = accumulate(stream, F.col("user_id"), F.col("kind"), F.lit(1), 3, 2).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.row, r.col): r.val for r in spark.table("sums").collect()}
    want = {}
    for i in range(100):
        want[i % 7, i % 3] = want.get((i % 7, i % 3), 0) + 1
    assert got == want


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.rmm").write_text("1 1\n1 0 0 1\n")
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert cli.main(["from-rows", str(tmp_path / "a.rmm"), a]) == 0 and cli.main(["canonical", a, b]) == 0
    assert cli.main(["equal", a, b]) == 0 and cli.main(["count", a, "1"]) == 0 and cli.main(["locate", a, "0"]) == 0 and cli.main(["print", b]) == 0
    assert capsys.readouterr().out.split() == ["3", "3", "equal", "2", "0", "1", "1", "0", "1", "0", "0", "1"]
    assert cli.main(["random", b, "2", "2", "--ones", "5"]) == 0 and cli.main(["equal", a, b]) == 1
