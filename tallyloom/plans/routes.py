"""The serving surface: each route is a parameterised query that returns named frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fundamentals, kin, lab, market, models, peers, serve, signals
from .binding import holdings, lenders

Frames = dict[str, DataFrame]


def lender_detail(spark: SparkSession, sf: str, key: str) -> Frames:
    """A lender, by number or name: its quarters, migration, generosity, score card and pressure."""
    who = lenders(spark, sf).filter(F.col("lender") == int(key) if key.isdigit() else F.lower("name") == key.lower())
    own = lambda df: df.join(who.select("lender"), "lender", "left_semi")
    lq = signals.loan_quarters(own(holdings(spark, sf)))
    return {
        "lender": who,
        "quarters": signals.lender_quarters(lq).orderBy("period"),
        "migration": lq.filter("NOT is_new").groupBy("period", "from_bucket", "bucket").count(),
        "generosity": own(signals.generosity(spark, sf)).orderBy("period"),
        "scorecard": own(models.lender_scorecard(spark, sf)),
        "forced": own(peers.forced_flags(spark, sf)).orderBy("period"),
        "fundamentals": own(fundamentals.fundamentals(spark, sf)).orderBy("period"),
    }


def loan_detail(spark: SparkSession, sf: str, loan_id: str) -> Frames:
    """A loan ("lender-borrower"): its history, who else holds the borrower, its risk."""
    lender, _, borrower = loan_id.partition("-")
    mine = (F.col("lender") == int(lender)) & (F.col("borrower") == borrower)
    h = holdings(spark, sf).filter(F.col("borrower") == borrower)
    return {"history": signals.loan_quarters(h).filter(mine).orderBy("period"), "peers": signals.shared_marks(h).filter(~mine).orderBy("period", "lender"), "risk": models.risk_score(spark, sf).filter(mine).orderBy("period")}


def borrower_detail(spark: SparkSession, sf: str, key: str) -> Frames:
    h = holdings(spark, sf).filter(F.col("borrower") == key)
    return {"loans": h.orderBy("lender", "period"), "marks": signals.shared_marks(h).orderBy("period", "lender")}


def stale_marks(spark: SparkSession, sf: str, top: int = 600) -> Frames:
    s = peers.stale_generosity(spark, sf)
    newest = s.agg(F.max("period").alias("top"))
    last = s.join(F.broadcast(newest), F.datediff("top", "period") <= 200).groupBy("lender").agg(F.max_by(F.struct("period", "generosity", "no_second"), "period").alias("r")).select("lender", "r.*")
    b = peers.stale_borrowers(spark, sf)
    return {"lenders": last, "borrowers": b.join(b.agg(F.max("period").alias("period")), "period", "left_semi").orderBy(F.desc("gap"), "borrower").limit(top), "test": peers.stale_test(spark, sf)}


def watchlists(spark: SparkSession, sf: str, top: int = 1500) -> Frames:
    return {"loans": models.watchlists(spark, sf).limit(top), "lenders": market.screen_quadrant(spark, sf).filter("quadrant <> 'neutral'").orderBy(F.desc("short_score"))}


def health(spark: SparkSession, sf: str) -> Frames:
    return {"health": spark.sql("SELECT 'ok' AS status")}


def one(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[..., Frames]:
    return lambda spark, sf: {name: query(spark, sf)}


ROUTES: dict[str, Callable[..., Frames]] = {
    "/api/status": one("status", serve.status),
    "/api/screen": one("screen", market.screen_quadrant),
    "/api/bdcs": lambda spark, sf, public_only=False: {"lenders": serve.lender_list(spark, sf).filter("public" if public_only else "TRUE")},
    "/api/bdcs/{key}": lender_detail,
    "/api/bdcs/{key}/loans": lambda spark, sf, key, period=None, flag=None, limit=None: {"loans": serve.lender_loans(spark, sf, key, period, flag, limit)},
    "/api/loans/{id}": loan_detail,
    "/api/borrowers": lambda spark, sf, q="%", limit=100: {"borrowers": serve.borrower_search(spark, sf, q).limit(limit)},
    "/api/borrowers/{key}": borrower_detail,
    "/api/insights/watchlists": watchlists,
    "/api/insights/validation": lambda spark, sf: {"lifts": models.lift_fit(spark, sf), "validated": models.validated(spark, sf), "backtest": models.ic_summary(spark, sf)},
    "/api/insights/scorecards": lambda spark, sf: {"scorecards": models.lender_scorecard(spark, sf).filter("n >= 50")},
    "/api/insights/sectors": one("sectors", serve.sectors),
    "/api/strategy": lambda spark, sf: {"book": models.strategy_book(spark, sf), "periods": models.quintile_spread(spark, sf), "summary": models.ic_summary(spark, sf), "turnover": models.turnover(spark, sf)},
    "/api/stale-marks": stale_marks,
    "/api/lab": lambda spark, sf: {"variants": models.strategy_variants(spark, sf), "fits": models.wf_lift_fit(spark, sf), "residuals": models.ols_residual(spark, sf), "periods": lab.signal_periods(spark, sf), "summary": lab.signal_summary(spark, sf)},
    "/api/neighbors": lambda spark, sf: {"pairs": kin.neighbor_pairs(spark, sf), "test": kin.neighbor_test(spark, sf), "watchlist": kin.neighbor_watchlist(spark, sf)},
    "/api/health": health,
}


def answer(spark: SparkSession, sf: str, path: str, **parameters) -> Frames:
    """The frames of a request's path; a path that no route has raises KeyError."""
    if path in ROUTES:
        return ROUTES[path](spark, sf, **parameters)
    parts = path.strip("/").split("/")
    for route, query in ROUTES.items():
        names = route.strip("/").split("/")
        if len(names) == len(parts) and all(n == p or n.startswith("{") for n, p in zip(names, parts)):
            bound = [p for n, p in zip(names, parts) if n.startswith("{")]
            return query(spark, sf, *bound, **parameters)
    raise KeyError(path)
