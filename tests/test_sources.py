import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.linkage import COLUMNS, link_loans
from tallyloom.sources.bulk import candidates, chosen, conformed, delimited, first_of_each, load, todo, upsert, zip_members
from tallyloom.sources.documents import facts, footnotes, inline_rows, page_text
from tallyloom.sources.sinks import clean, column_json, json_shards, numbered, write_shards, write_tree
from tallyloom.streaming.streams import link_stream, restate, restated

DOC = """<html xmlns:ix="http://x/ix" xmlns:xbrli="http://x/i" xmlns:xbrldi="http://x/d"><body>
<xbrli:context id="c1"><xbrli:entity><xbrli:segment><xbrldi:typedMember><x>Acme Loan</x></xbrldi:typedMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2024-03-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:period><xbrli:instant>2024-03-31</xbrli:instant></xbrli:period></xbrli:context>
<ix:nonFraction id="f1" contextRef="c1" name="FV" scale="3" sign="-">1,234</ix:nonFraction>
<ix:nonFraction id="f2" contextRef="c1" name="Cost" format="ixt:num-comma-decimal">1.234,5</ix:nonFraction>
<ix:nonFraction id="f3" contextRef="c2" name="Total">9</ix:nonFraction>
<ix:nonFraction id="f4" contextRef="c1" name="Nil" xmlns:xsi="http://x/s" xsi:nil="true"/>
<ix:nonNumeric id="t1" contextRef="c1" name="Industry">Soft  ware</ix:nonNumeric>
<ix:footnote id="n1">On non-accrual.</ix:footnote><ix:relationship fromRefs="f1 f2 f3" toRefs="n1"/>
</body></html>"""


def test_inline_documents(spark):
    rows = inline_rows(spark.createDataFrame([("a", DOC.encode()), ("b", b"<broken")], "path string, content binary"))
    got = {r.name: (r.identifier, r.value, r.text, r.ddate) for r in facts(rows).collect()}
    day = dt.date(2024, 3, 31)
    assert got == {"FV": ("Acme Loan", -1234000.0, None, day), "Cost": ("Acme Loan", 1234.5, None, day), "Industry": ("Acme Loan", None, "Soft ware", day)}
    assert [(r.doc, r.identifier, r.footnote) for r in footnotes(rows).collect()] == [("a", "Acme Loan", "On non-accrual.")]
    assert rows.filter("kind = 'error'").count() == 1


def test_ragged_delimited_files_and_schemas(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('adsh\tVALUE\tddate\textra\na\t1.5\t20240331\t"q\nb\t\tbad\nc\tx\t2024-06-30\tz\textra\n')
    schema = T.StructType([T.StructField("adsh", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("ddate", T.DateType()), T.StructField("fy", T.IntegerType()), T.StructField("source_file", T.StringType())])
    df = conformed(delimited(spark, str(tmp_path / "x.tsv")), schema, F.lit("x"))
    got = [tuple(r) for r in df.orderBy("adsh").collect()]
    assert got == [("a", 1.5, dt.date(2024, 3, 31), None, "x"), ("b", None, None, None, "x"), ("c", None, dt.date(2024, 6, 30), None, "x")]
    for name in ("x", "y", "x"):
        load(df.withColumn("source_file", F.lit(name)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("source_file").count().count() == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_zip_members(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("num.tsv", "a\tb\n1\t2\n")
        z.writestr("other.tsv", "x\n")
    (tmp_path / "f.zip").write_bytes(data.getvalue())
    assert [(r.member, r.line_no, r.line) for r in zip_members(spark, str(tmp_path), ["num.tsv", "sub.tsv"]).orderBy("line_no").collect()] == [("num.tsv", 0, "a\tb"), ("num.tsv", 1, "1\t2")]


def test_candidates_and_choice():
    files = candidates(today=dt.date(2026, 3, 15))
    assert [f.name for f in files[:2]] == ["2022q4", "2023q1"] and [f.name for f in files[-4:]] == ["2025q4", "2026_01", "2026_02", "2026_03"]
    assert [f.name for f in chosen(files, since="2026_02", loaded={"2026_03"})] == ["2026_02"]
    assert [f.name for f in chosen(files, only="2023q1", loaded={"2023q1"}, force=True)] == ["2023q1"]
    with pytest.raises(ValueError):
        chosen(files, since="nope")


def test_upserts_and_work_lists(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in todo(new, old, ["k"]).collect()] == [3]
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik": "7", "ticker": "A"}, "1": {"cik": "8", "ticker": "B"}, "10": {"cik": "7", "ticker": "Z"}}))
    assert {(r.cik, r.fields["ticker"]) for r in first_of_each(spark, str(tmp_path / "t.json")).collect()} == {("7", "A"), ("8", "B")}


def test_json(spark, tmp_path):
    rows = [("b", 2, float("nan"), 1.23456789, dt.date(2024, 1, 2), 'say "hi"\n'), ("b", 1, 1.0, None, None, None), ("a", 1, float("inf"), 0.1, None, "é")]
    df = spark.createDataFrame(rows, "k string, n int, x double, y double, d date, s string")
    got = {r.k: json.loads(r.json) for r in column_json(clean(df), ["k"], ["n", "x", "y", "d", "s"], ["n"]).collect()}
    assert got["b"] == {"cols": ["n", "x", "y", "d", "s"], "rows": [[1, 1.0, None, None, None], [2, None, 1.234568, "2024-01-02", 'say "hi"\n']]}
    shards = json_shards(df, "k", 16, ["n", "s"], ["n"])
    whole, lines = {}, {}
    for r in shards.orderBy("shard", "n").collect():
        lines.setdefault(r.shard, []).append(r.line)
    for own in lines.values():
        whole |= json.loads("\n".join(own))
    assert set(whole) == {"a", "b"} and whole["a"]["rows"] == [[1, "é"]]
    write_shards(shards, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == shards.count()
    for folder in (tmp_path / "s").glob("shard=*"):
        assert json.loads("".join(f.read_text() for f in sorted(folder.glob("*.txt"))))
    tree = write_tree(df.select("k", "n", "d"), ["k"], str(tmp_path / "tree"))
    assert {(r.k, r.n) for r in tree.collect()} == {("a", 1), ("b", 2)} and (tmp_path / "tree/tree/k=b").exists()
    coded = numbered(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (1, 4, None)], "g int, i int, t string"), ["g"], "t", ["i"]).orderBy("i").collect()
    assert [(r.t, r.t_dict) for r in coded] == [(0, ["x", "y"]), (1, ["x", "y"]), (0, ["x", "y"]), (None, ["x", "y"])]


def test_page_text(spark):
    html = "<html><title>T</title><script>var x='<p>';</script><p>a &amp; b</p><!-- no --><p class='q'>c <a href='/x'>d</a></html>"
    r = page_text(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].n_links, r[0].n_paragraphs, r[0].text) == ("T", 1, 2, "T a & b c d") and r[1].text is None


def test_restatements_in_any_order(spark, tmp_path):
    for i, rows in enumerate([[(1, 10.0, 2), (2, 5.0, 1)], [(1, 9.0, 1), (1, None, 9)], [(2, 6.0, 3), (2, 6.0, 3)]]):
        spark.createDataFrame(rows, "k int, value double, filed int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k int, value double, filed int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = restate(stream, ["k"], "value", "filed", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    assert sorted(tuple(r) for r in restated(spark, f"{tmp_path}/out", last).select("k", "value", "filed").collect()) == [(1, 10.0, 2), (2, 6.0, 3)]


def test_linkage_by_stream_equals_batch(spark, tmp_path):
    rows = [(1, dt.date(2024, 3 * q, 1), f"n{i} v{q % 2}", "", f"n{i}", f"n{i}", "loan", "", "", True, 100.0 + i) for q in (1, 2, 3) for i in range(4) if (q + i) % 4]
    schema = "lender int, period date, " + ", ".join(f"{c} {'boolean' if c == 'debt' else 'double' if c == 'amount' else 'string'}" for c in COLUMNS)
    df = spark.createDataFrame(rows, schema)
    for q in (3, 6, 9):
        df.filter(F.month("period") == q).coalesce(1).write.parquet(f"{tmp_path}/in/{q:02d}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    link_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.period, r.identifier, r.loan_id, r.match_method)
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(key, link_loans(df).collect()))


def test_placed_lines_make_the_same_tree_without_moving(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyloom.sources import tree

    rows = spark.range(60).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    lines = tree.table_lines(rows, F.concat(F.lit("a/"), F.col("k"), F.lit(".json")), ["k", "v"], ["v"]).unionByName(tree.table_lines(rows, F.lit("all.json"), ["v"], ["v"]))
    for placed in (False, True):
        tree.write(lines, str(tmp_path / str(placed)), placed=placed)
    read = lambda placed: sorted((r.path, list(r.row)) for o in ("a/*.json", "all.json") for r in tree.tables(spark, str(tmp_path / str(placed)), o).collect())
    assert read(True) == read(False) and len(read(True)) == 120
    assert tree.manifest(str(tmp_path / "True"))["objects"] == 8
