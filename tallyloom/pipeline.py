"""The stages of a build as a declared graph, and the command line.

    python -m tallyloom.pipeline build all --tables DIR --out DIR
    python -m tallyloom.pipeline build signals --tables DIR --out DIR
    python -m tallyloom.pipeline query loan_quarter --tables DIR
    python -m tallyloom.pipeline answer /api/bdcs/7/loans --tables DIR flag=stressed
    python -m tallyloom.pipeline export --tables DIR --out DIR
    python -m tallyloom.pipeline ingest --files DIR --out DIR [--since NAME | --only NAME] [--force]
"""

from __future__ import annotations

import argparse
import hashlib
from graphlib import TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import binding, registry, routes, serve
from .session import session
from .sources import bulk, sinks, tree

#: Each stage with the stages it needs and the tables it writes.
STAGES: dict[str, tuple[list[str], list[str]]] = {
    "holdings": ([], ["eav_pivot", "reconciliation", "period_source", "exclusion_ledger", "unit_fixes"]),
    "loans": (["holdings"], ["link_loans", "loan_history_summary"]),
    "signals": (["loans"], ["loan_quarter", "bdc_quarter", "bdc_latest", "migration", "borrower_marks", "generosity"]),
    "prices": ([], ["price_points", "pnav_nearest"]),
    "fundamentals": (["signals", "prices"], ["fundamentals", "nav_known", "fundamentals_band"]),
    "screen": (["fundamentals"], ["screen_quadrant"]),
    "insights": (["screen"], ["forward_label", "lift_fit", "risk_score", "sector_rollup", "vintage_rollup", "bdc_validated", "lender_scorecard", "watchlists"]),
    "backtest": (["insights"], ["bt_universe", "spearman_ic", "ic_summary", "quintile_spread", "walk_forward_composite", "strategy_book"]),
    "stale": (["signals"], ["stale_borrowers", "stale_generosity", "stale_test"]),
    "forced": (["fundamentals"], ["forced_flags", "forced_test_bootstrap"]),
    "neighbors": (["signals"], ["knn_borrowers", "knn_test_grouping_sets", "neighbor_pairs", "neighbor_test", "neighbor_watchlist"]),
    "lab": (["backtest", "stale"], ["wf_lift_fit", "ols_residual", "strategy_variants", "turnover", "signal_periods", "signal_summary"]),
}
#: What "all" builds; back-tests and the lab are asked for by name.
ALL = [s for s in STAGES if s not in ("lab", "backtest")]


def order(stages: list[str]) -> list[str]:
    """The stages and all that they need, each after what it needs."""
    wanted, todo = set(), list(stages)
    while todo:
        s = todo.pop()
        if s not in wanted:
            wanted.add(s)
            todo += STAGES[s][0]
    return list(TopologicalSorter({s: STAGES[s][0] for s in STAGES if s in wanted}).static_order())


def sources(spark: SparkSession, tables: str) -> str:
    """What tells one state of the base tables from another: their files' names, sizes and times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(seen))


def keys(spark: SparkSession, tables: str, stages: list[str]) -> dict[str, str]:
    """Of each stage a key that changes with the base tables, the package's own code and the stages it needs."""
    code = hashlib.sha256(b"".join(f.read_bytes() for f in sorted(Path(__file__).parent.rglob("*.py")) if "llm" not in f.parts)).hexdigest()
    base, out = sources(spark, tables), {}
    for stage in stages:
        out[stage] = hashlib.sha256("\n".join([base, code, stage, *(out[s] for s in STAGES[stage][0])]).encode()).hexdigest()
    return out


def build(spark: SparkSession, tables: str, out: str, stages: list[str], force: bool = False) -> list[str]:
    """Writes every table of the stages under ``out`` that isn't there in this state; returns the names of those written.

    The holdings are written first, and all stages read that table. A table's key is written after
    it, so a build that broke off goes on where it was; ``force`` writes all anew.
    """
    at = f"{out}/_keys"
    there = {r.name: r.key for r in spark.read.schema("name string, key string, at timestamp").json(at).orderBy("at").collect()} if bulk.Loads(spark, out)._there(at) else {}
    ordered = order(stages)
    key_of, written = keys(spark, tables, ordered), []
    base = hashlib.sha256(sources(spark, tables).encode()).hexdigest()

    def wrote(name: str, df: DataFrame, key: str) -> None:
        sinks.write_table(df, f"{out}/{name}")
        spark.range(1).select(F.lit(name).alias("name"), F.lit(key).alias("key"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(at)
        written.append(name)

    if force or there.get("_holdings") != base:
        wrote("_holdings", binding.computed_holdings(spark, tables), base)
    mine = spark.sparkContext.applicationId, tables
    binding.WRITTEN[mine] = f"{out}/_holdings"
    try:
        for stage in ordered:
            for name in STAGES[stage][1]:
                if force or there.get(name) != key_of[stage]:
                    wrote(name, registry.QUERIES[name](spark, tables), key_of[stage])
    finally:
        del binding.WRITTEN[mine]
    return [n for n in written if n != "_holdings"]


def export(spark: SparkSession, tables: str, out: str) -> dict:
    """The static tree as one new version: lenders, their periods, loans and borrowers in shards, overviews. Returns its manifest."""
    tree.write(serve.tree_lines(spark, tables), f"{out}/tree")
    for name in ("status", "screen_quadrant", "sectors", "lender_list", "watchlists", "lender_scorecard"):
        sinks.clean(registry.QUERIES[name](spark, tables)).write.mode("overwrite").json(f"{out}/{name}")
    return tree.manifest(f"{out}/tree")


def ingest(spark: SparkSession, files: str, out: str, since: str | None = None, only: str | None = None, force: bool = False) -> list[str]:
    """Loads the candidate files that stand under ``files`` and that the log doesn't have; returns their names."""
    loads = bulk.Loads(spark, out)
    new = [f.name for f in bulk.chosen(bulk.candidates(), since, only, loads.names(), force) if loads._there(f"{files}/{f.name}.tsv")]
    for name in new:
        loads.load(name, bulk.delimited(spark, f"{files}/{name}.tsv"))
    return new


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["build", "query", "answer", "export", "ingest"])
    parser.add_argument("what", nargs="*")
    for option in ("tables", "out", "files", "since", "only"):
        parser.add_argument(f"--{option}")
    parser.add_argument("--force", action="store_true")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "build":
        print(*build(spark, a.tables, a.out, ALL if a.what == ["all"] else a.what, a.force))
    elif a.command == "query":
        registry.QUERIES[a.what[0]](spark, a.tables).show(50, truncate=False)
    elif a.command == "answer":
        for name, frame in routes.answer(spark, a.tables, a.what[0], **dict(p.split("=", 1) for p in a.what[1:])).items():
            print(name)
            frame.show(20, truncate=False)
    elif a.command == "export":
        print(export(spark, a.tables, a.out))
    else:
        print(*ingest(spark, a.files, a.out, a.since, a.only, a.force))


if __name__ == "__main__":
    main()
