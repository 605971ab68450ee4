import pytest

from pyspark.sql import functions as F

from tallyloom import pipeline
from tallyloom.plans import registry
from tallyloom.plans.routes import ROUTES, answer
from tallyloom.sources import tree
from tallyloom.sources.bulk import Loads

SF = "/root/testdata/sf0.001"


def test_stages_come_after_what_they_need():
    got = pipeline.order(["lab"])
    assert set(got) >= {"holdings", "signals", "backtest", "stale"} and got[-1] == "lab"
    for stage, (needs, tables) in pipeline.STAGES.items():
        assert all(t in registry.QUERIES for t in tables) and all(n in pipeline.STAGES for n in needs)
    assert "lab" not in pipeline.ALL and "backtest" not in pipeline.ALL


def test_build_and_export(spark, tmp_path):
    assert pipeline.build(spark, SF, str(tmp_path / "out"), ["loans"])[-1] == "loan_history_summary"
    assert spark.read.parquet(str(tmp_path / "out" / "loan_history_summary")).count() > 0
    pipeline.export(spark, SF, str(tmp_path / "web"))
    assert spark.read.json(str(tmp_path / "web" / "status")).first().n_lenders == 10


def test_a_build_computes_holdings_once_and_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    out, computed, real = str(tmp_path / "out"), [], pipeline.binding.computed_holdings
    monkeypatch.setattr(pipeline.binding, "computed_holdings", lambda *a: computed.append(a) or real(*a))
    broken = dict(registry.QUERIES)
    monkeypatch.setattr(registry, "QUERIES", broken)
    good = broken["link_loans"]
    broken["link_loans"] = lambda *a: 1 / 0
    monkeypatch.setitem(pipeline.STAGES, "holdings", ([], ["eav_pivot"]))
    monkeypatch.setitem(pipeline.STAGES, "signals", (["loans"], ["bdc_quarter", "generosity"]))
    with pytest.raises(ZeroDivisionError):
        pipeline.build(spark, SF, out, ["signals"])
    assert not pipeline.binding.WRITTEN
    broken["link_loans"] = good
    assert pipeline.build(spark, SF, out, ["signals"]) == ["link_loans", "loan_history_summary", "bdc_quarter", "generosity"]
    assert len(computed) == 1 and pipeline.build(spark, SF, out, ["signals"]) == []
    assert spark.read.parquet(f"{out}/bdc_quarter").count() == registry.QUERIES["bdc_quarter"](spark, SF).count()


def test_a_half_written_load_is_no_part_of_the_table(spark, tmp_path):
    loads = Loads(spark, str(tmp_path / "raw"))
    assert loads.names() == set()
    rows = lambda n: spark.range(n).select(F.col("id").alias("a"))
    one = loads.load("x", rows(5))
    rows(7).write.parquet(str(tmp_path / "raw/source_file=y/batch=broken"))  # its line was never written
    assert loads.names() == {"x"} and loads.table().count() == 5
    loads.load("y", rows(3))
    again = loads.load("x", rows(5).orderBy(F.desc("a")))
    assert again["hash"] == one["hash"] and again["rows"] == 5 and again["batch"] != one["batch"]
    assert {r.source_file: r.n for r in loads.table().groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {"x": 5, "y": 3}
    assert not (tmp_path / "raw/source_file=y/batch=broken").exists()


def test_a_tree_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "tree")
    df = spark.range(30).select((F.col("id") % 4).alias("k"), "id", F.col("id").cast("double").alias("v"), F.lit('a"b').alias("s"))
    lines = lambda d: tree.table_lines(d, F.concat(F.lit("x/"), F.col("k"), F.lit(".json")), ["id", "v", "s"], ["id"])
    tree.write(lines(df), root)
    first = tree.current(root)
    got = tree.tables(spark, root, "x/*.json")
    assert got.count() == 30 and got.filter("path = 'x/1.json'").first().row == ["1", "1.0", 'a"b'] and tree.manifest(root)["objects"] == 4 and tree.manifest(root)["lines"] == 30
    bad = lines(df).withColumn("line", F.when(F.col("n") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        tree.write(bad, root)
    assert tree.current(root) == first and tree.tables(spark, root, "x/*.json").count() == 30
    tree.write(lines(df.filter("id < 10")), root)
    assert tree.current(root) != first and tree.tables(spark, root, "x/*.json").count() == 10


def test_ingest_skips_what_is_loaded(spark, tmp_path):
    for name in ("2023q1", "2023q2"):
        (tmp_path / f"{name}.tsv").write_text("a\tb\n1\t2\n")
    run = lambda **k: pipeline.ingest(spark, str(tmp_path), str(tmp_path / "raw"), **k)
    assert run() == ["2023q1", "2023q2"] and run() == [] and run(only="2023q1", force=True) == ["2023q1"]
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


@pytest.mark.parametrize("path", [r.replace("{key}/loans", "7/loans").replace("/bdcs/{key}", "/bdcs/7").replace("/borrowers/{key}", "/borrowers/red widget").replace("{id}", "7-red widget") for r in ROUTES])
def test_every_route_answers(spark, path):
    assert all(f.limit(3).count() >= 0 and f.columns for f in answer(spark, SF, path).values())


def test_parameters_and_unknown_paths(spark):
    rows = answer(spark, SF, "/api/bdcs/7/loans", flag="stressed", limit=2)["loans"].collect()
    assert len(rows) <= 2 and all(r.stressed for r in rows)
    by_name = answer(spark, SF, "/api/bdcs/supplier#000000007")["lender"].collect()
    assert [r.lender for r in by_name] == [7]
    with pytest.raises(KeyError):
        answer(spark, SF, "/api/none")
