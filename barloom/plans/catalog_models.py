"""Model queries on a ranked weekly feature frame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.config import FeatureConfig, LabelConfig, ModelConfig, weekly
from barloom.operators import features as ft, labels as lb, ledger as ld, metrics as mt, models as md
from barloom.operators.linear import block_moments
from barloom.operators.panel import with_sessions
from barloom.plans.catalog_books import BOOK, H, SIG
from barloom.plans.catalog_features import FEATS, LABELS, LOWH
from barloom.plans.catalog_panel import UNI, UNIV
from barloom.plans.datasets import prepare_dataset
from barloom.plans.registry import query
from barloom.plans.sqlparts import GRID, PANEL, with_
from barloom.sources.signals import kept_scores

CFG = FeatureConfig()
COLS = ft.names(CFG)
RUN = replace(weekly(), data=UNI)
MODEL = RUN.model
SPLITS = RUN.splits
GAP = H + SPLITS.embargo


def frame(t):
    """Ranked features with labels and the low-day class, on own bars; stored once a query."""
    def make():
        bars = t.keep("bars", t.weekly_bars)
        lab = lb.build_labels(bars, LabelConfig(horizon=H), t.names_bound)
        low = lb.low_day(with_sessions(bars), LOWH).select("date", "ticker", "sid", "low_day")
        side = t.keep("labels", lambda: lab.join(low, ["date", "ticker"]))
        return ft.compute_features(bars, CFG, t.names_bound, side)
    return t.keep("frame", make)


def dataset(t):
    """Tradable rows with features and labels, as models see them; stored once a query."""
    return t.keep("dataset", lambda: prepare_dataset(t.keep("bars", t.weekly_bars), RUN, t.names_bound))


def walk(t, models=("ridge", "gbt"), features=None, d=None):
    return md.walk_forward(dataset(t) if d is None else d, features or COLS, SPLITS, replace(MODEL, models=models), H)


LIVE = " + ".join(f"(r.{c} is not null)::int" for c in COLS)


DATASET = FEATS + UNIV[len(PANEL):] + LABELS[len(GRID):] + f""", ds as (
  select r.date, r.ticker, l.fwd_ret, l.ret_next_1d, l.target, u.close, {', '.join('r.' + c for c in COLS)}
  from ranked r join labels_w l on l.date = r.date and l.ticker = r.ticker join univ u on u.date = r.date and u.ticker = r.ticker
  where u.tradable and ({LIVE}) / {len(COLS)}.0 >= 0.5)"""


@query("prepare_dataset", "date:d ticker:s fwd_ret:f ret_next_1d:f target:f close:f " + " ".join(f"{c}:f" for c in COLS),
       with_(DATASET, "select * from ds", True))
def _(t):
    return dataset(t)


@query("ridge_moments", "fold:i feature:s rows_:i mean:f spread:f with_target:f", with_(DATASET + f""",
  days as (select date, row_number() over (order by date) - 1 as day, count(*) over () as n from (select distinct date from ds)),
  tests as (select k, n - {SPLITS.test_size} * (k + 1) as start from (select distinct n from days), range({SPLITS.n_splits}) t_(k)
            where n - {SPLITS.test_size} * (k + 1) - {GAP} >= {SPLITS.min_train}),
  trains as (select (select max(k) from tests) - k as fold, start - {GAP} as n, cast(floor((start - {GAP}) * 0.15) as int) as nv from tests),
  fits as (select fold, case when nv < 20 or n - nv - {GAP} < 50 then n else n - nv - {GAP} end as upto from trains),
  long as (unpivot (select fold, target, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in COLS)} from ds join days using (date)
           join fits on day < upto where target is not null) on {', '.join(COLS)} into name feature value v)""",
    """select fold, feature, count(*) as rows_, avg(v) as mean, stddev_pop(v) as spread,
  sum(v * target) - count(*) * avg(v) * avg(target) as with_target from long group by fold, feature""", True))
def _(t):
    """What ridge sees of each fold's training block, from the running sums of products."""
    d, blocks = md.fold_blocks(dataset(t), SPLITS, MODEL, H)
    rows = []
    for fold, m in block_moments(d, COLS, ["target"], blocks["fit"]).items():
        xx, xy = m.centred()
        rows += [(fold, c, int(m.n), float(m.means()[i]), float(max(xx[i, i], 0.0) / m.n) ** 0.5, float(xy[i, 0])) for i, c in enumerate(COLS)]
    return d.sparkSession.createDataFrame(rows, "fold int, feature string, rows_ long, mean double, spread double, with_target double")


@query("evaluate_full", "model:s ic_mean:f ic_t_stat:f ic_days:i")
def _(t):
    """Universe, 33 features, labels, tradable rows, walk-forward of both models, ensemble and skill, end to end."""
    p = walk(t)[0]
    p = p.unionByName(ld.ensemble_zscore(p).withColumn("model", F.lit("ensemble")))
    j = p.join(dataset(t).select("date", "ticker", "fwd_ret"), ["date", "ticker"])
    return mt.ic_summary(mt.daily_ic(j, "score", "fwd_ret", 20, t.names_bound))


@query("ridge_fit_predict", "date:d ticker:s score:f")
def _(t):
    return walk(t, ("ridge",))[0]


@query("gbt_fit_predict", "date:d ticker:s score:f")
def _(t):
    return walk(t, ("gbt",))[0]


@query("walk_forward_predict", "date:d ticker:s model:s score:f")
def _(t):
    return walk(t)[0]


@query("model_registry", "model:s ic_mean:f ic_t_stat:f ic_days:i")
def _(t):
    j = walk(t)[0].join(dataset(t).select("date", "ticker", "fwd_ret"), ["date", "ticker"])
    return mt.ic_summary(mt.daily_ic(j, "score", "fwd_ret", 20, t.names_bound))


@query("importance_average", "model:s feature:s importance:f")
def _(t):
    return md.importance_average(walk(t)[1])


@query("topk_importance", "model:s feature:s importance:f")
def _(t):
    return md.topk_importance(md.importance_average(walk(t, ("ridge",))[1]), "ridge", 5)


@query("multiclass_fit_predict", "accuracy:f base_rate:f lift:f n:i")
def _(t):
    return lb.accuracy(md.low_day_classifier(frame(t), COLS, 240, LOWH + SPLITS.embargo, trees=10, depth=4), "guess", "low_day")


@query("permutation_null_test", "seed:i ic_mean:f ic_t_stat:f ic_days:i")
def _(t):
    return md.permutation_null_test(dataset(t), COLS, SPLITS, ModelConfig(), H, 12, BOOK.min_names, t.names_bound)


@query("leak_positive_control", "model:s ic_mean:f ic_t_stat:f fired:b")
def _(t):
    d = md.add_leak(dataset(t), "target", 0.5, 7)
    p = walk(t, ("ridge",), COLS + ["leak"], d)[0].join(dataset(t).select("date", "ticker", "fwd_ret"), ["date", "ticker"])
    return mt.ic_summary(mt.daily_ic(p, "score", "fwd_ret", 20, t.names_bound)).withColumn("fired", F.abs("ic_t_stat") > 20)


@query("causality_check", "feature:s rows_:i changed:i")
def _(t):
    def make(panel):
        return ft.compute_features(panel, CFG, t.names_bound)
    return md.causality_check(t.keep("bars", t.weekly_bars), make, "1999-06-28", COLS)


@query("sequence_windows", "date:d ticker:s n:i first:f last:f total:f", with_(SIG, """, s as (select date, ticker, least(greatest(coalesce(mom, 0.0), -5.0), 5.0) as m, least(greatest(coalesce(rev, 0.0), -5.0), 5.0) as r from sc where close is not null),
  w as (select date, ticker, count(*) over x as n, first_value(m) over x as first, m as last, sum(m + r) over x as total from s window x as (partition by ticker order by date rows between 19 preceding and current row))
  select * from w where n = 20"""))
def _(t):
    d = md.sequence_windows(kept_scores(t, H), ["mom", "rev"], 20)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v[0] + v[1])
    return d.select("date", "ticker", F.size("window").alias("n"), F.element_at("window", 1)[0].alias("first"),
                    F.element_at("window", -1)[0].alias("last"), total.alias("total"))


@query("model_ensemble", "date:d ticker:s score:f")
def _(t):
    return ld.ensemble_zscore(walk(t)[0])
