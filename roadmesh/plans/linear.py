"""Registered queries of linear models over all cities and folds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cities, forests, linear, order, splits
from . import cities as city_plans
from .catalog import FEATURES, query, rounded
from .inputs import Inputs

ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


def city_folds(i: Inputs) -> DataFrame:
    """The matrix with seven unshuffled folds of each city."""
    return splits.contiguous_folds_within(i.matrix(), ["city"], "row_id", 7)


_FOLDS = "(select *, ntile(7) over (partition by city order by row_id)-1 as fold from matrix)"


def fits_sql(rows: str, group: str, fold: str, alphas: list[float], xs: list[str] = FEATURES) -> str:
    """Common tables that end in fits(group, fold, alpha, n_train, n_test, intercept, w_*, b_*, r2, mse):
    the normal equations of every fold, solved by elimination, a step per table."""
    pairs = [(a, b) for k, a in enumerate(xs) for b in xs[k:]]
    p = lambda a, b: f"p_{a}_{b}" if (a, b) in pairs else f"p_{b}_{a}"
    sums = {"n": "count(*)::double", "sy": "sum(y)", "syy": "sum(y*y)", **{f"s_{a}": f"sum({a})" for a in xs}, **{p(a, b): f"sum({a}*{b})" for a, b in pairs}, **{f"xy_{a}": f"sum({a}*y)" for a in xs}}
    own = ", ".join(f"{sql} as {c}" for c, sql in sums.items())
    rest = ", ".join(f"sum({c}) over (partition by {group}) - {c} as t_{c}" for c in sums)
    g = lambda a, b: f"(t_{p(a, b)}/t_n - t_s_{a}/t_n*t_s_{b}/t_n)"
    scaled = ", ".join([f"{g(a, b)}/(d_{a}*d_{b}){' + alpha/t_n' if a == b else ''} as m_{a}_{b}" for a in xs for b in xs] + [f"(t_xy_{a}/t_n - t_s_{a}/t_n*t_sy/t_n)/d_{a} as m_{a}_y" for a in xs])
    out = f"""own as materialized (select {group}, {fold}, {own} from {rows} group by all),
parted as materialized (select * from (select *, {rest} from own) where n>=5 and t_n>=5),
spread as materialized (select *, {', '.join(f'case when sqrt(greatest({g(a, a)}, 0))=0 then 1.0 else sqrt(greatest({g(a, a)}, 0)) end as d_{a}' for a in xs)} from parted),
e0 as materialized (select {group}, {fold}, alpha, {scaled} from spread, (select unnest([{', '.join(f'{a}::double' for a in alphas)}]) as alpha))"""
    for k, pivot in enumerate(xs):
        cols = [*xs[k + 1 :], "y"]
        step = ", ".join(f"m_{a}_{b}/m_{pivot}_{pivot} as m_{a}_{b}" if a == pivot else f"m_{a}_{b} - m_{a}_{pivot}*m_{pivot}_{b}/m_{pivot}_{pivot} as m_{a}_{b}" for a in xs for b in cols)
        out += f",\ne{k + 1} as materialized (select {group}, {fold}, alpha, {step} from e{k})"
    inner = "+".join(f"w_{a}*w_{b}*{p(a, b)}" for a in xs for b in xs)
    return out + f""",
solved as materialized (select s.*, alpha, {', '.join(f'm_{a}_y as b_{a}, m_{a}_y/d_{a} as w_{a}' for a in xs)} from e{len(xs)} join spread s using ({group}, {fold})),
offset_ as materialized (select *, t_sy/t_n - ({'+'.join(f'w_{a}*t_s_{a}/t_n' for a in xs)}) as w0 from solved),
fits as materialized (select {group}, {fold}, alpha, t_n::bigint as n_train, n::bigint as n_test, w0 as intercept, {', '.join(f'w_{a}, b_{a}' for a in xs)}, case when syy-sy*sy/n>0 then 1-sse/(syy-sy*sy/n) end as r2, sse/n as mse
  from (select *, syy - 2*(w0*sy+{'+'.join(f'w_{a}*xy_{a}' for a in xs)}) + n*w0*w0 + 2*w0*({'+'.join(f'w_{a}*s_{a}' for a in xs)}) + ({inner}) as sse from offset_))"""


_WIDE = ", ".join(f"round(w_{a},6) as {a}" for a in FEATURES)


def wide(fits: DataFrame) -> DataFrame:
    return rounded(fits.select("city", F.col("fold").cast("long").alias("fold"), "alpha", "n_train", "n_test", "intercept", "r2", "mse", *(F.get("coef", F.lit(k)).alias(a) for k, a in enumerate(FEATURES))))


@query(f"select * from (with {fits_sql(_FOLDS, 'city', 'fold', [0.0, 1.0])} select city, fold, alpha, n_train, n_test, round(intercept,6) as intercept, round(r2,6) as r2, round(mse,6) as mse, {_WIDE} from fits)")
def m5_m6_v7_m15_city_fits(i: Inputs) -> DataFrame:
    """Least squares and ridge of all cities and folds: scaled on the training rows, scored on the fold."""
    return wide(linear.fit_folds(city_folds(i), ["city"], "fold", FEATURES, "y", [0.0, 1.0]))


@query(f"select * from (with {fits_sql(_FOLDS, 'city', 'fold', [0.0])} select city, round(avg(r2),6) as mean, round(stddev_pop(r2),6) as std, round(median(r2),6) as middle, count(r2) as folds from fits group by city)")
def m19_a16_a17_city_scores(i: Inputs) -> DataFrame:
    """The cross-validated R2 of each city over its seven unshuffled folds."""
    f = linear.fit_folds(city_folds(i), ["city"], "fold", FEATURES, "y", [0.0])
    return rounded(f.groupBy("city").agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"), F.median("r2").alias("middle"), F.count("r2").alias("folds")))  # seven values a city


@query(
    f"select city, alpha, feature, round(importance,6) as importance from (with {fits_sql(_FOLDS, 'city', 'fold', ALPHAS)}, means as (select city, alpha, avg(r2) as r2, {', '.join(f'avg(abs(b_{a})) as {a}' for a in FEATURES)} from fits group by all), best as (select * exclude (r2) from means qualify row_number() over (partition by city order by r2 desc, alpha)=1) unpivot best on {', '.join(FEATURES)} into name feature value importance)"
)
def m8_city_ridge_choice(i: Inputs) -> DataFrame:
    """The alpha of seven that does best over a city's folds, and its absolute coefficients."""
    return rounded(linear.ridge_choice(linear.fit_folds(city_folds(i), ["city"], "fold", FEATURES, "y", ALPHAS), ["city"], FEATURES))


#: The tile features that the spatial folds train on.
TILE_XS = ["n", "m", "edge_length_avg", "streets_per_node_avg"]
_TILE = 'city, scale, "row", col'
_MATRIX_SQL = f"""(select f.*, j.y from (select {_TILE}, n::double as n, m::double as m, edge_length_avg, streets_per_node_avg from ({city_plans.CITY_FEATURES_SQL})) f
  join (select t.city, t.scale, t."row", t.col, avg(v.jf) as y from city_seg_tile t join seg_value v on v.nid=t.nid group by all) j using ({_TILE}))"""
_STRIPS_SQL = f"""tm as materialized (select * from {_MATRIX_SQL}),
sv as (select *, row_number() over (partition by city, scale order by x)-1 as i, count(*) over (partition by city, scale) as total from (select distinct city, scale, unnest([col, col+1]) as x from tm)),
se as (select city, scale, row_number() over (partition by city, scale order by x)-1 as k, x as a, lead(x) over (partition by city, scale order by x) as b from sv where (i % greatest(total//5, 1)=0 and i<5*greatest(total//5, 1)) or i=total-1),
tiled as materialized (select tm.*, strip from tm join (select {_TILE}, min(k) as strip from tm join se using (city, scale) where col>=a and col+1<=b group by all) using ({_TILE}))"""


def tile_matrix(i: Inputs) -> DataFrame:
    """The features TILE_XS of each city's tiles with their mean congestion y."""
    y = city_plans.congestion(i).where("mean is not null").select(*cities.CITY_KEY, F.col("mean").alias("y"))
    f = cities.features(city_plans.tile_edges(i), city_plans.grids(i)).select(*cities.CITY_KEY, *TILE_XS)
    return f.join(y, cities.CITY_KEY)


@query(f"select * from (with {_STRIPS_SQL}, {fits_sql('tiled', 'city, scale', 'strip', [1.0], TILE_XS)} select city, scale, strip, n_train, n_test, round(r2,4) as r2, round(mse,4) as mse, {', '.join(f'round(b_{a},4) as {a}' for a in TILE_XS)} from fits)")
def v3_v6_m6_strip_fits(i: Inputs) -> DataFrame:
    """Each vertical strip of a city's tiles held out in turn: ridge on the other strips, scored
    on it; strips where either side has fewer than five tiles go."""
    folds = splits.strips_within(tile_matrix(i).withColumn("next", F.col("col") + 1), ["city", "scale"], "col", "next", 5)
    got = linear.fit_folds(folds, ["city", "scale"], "strip", TILE_XS, "y", [1.0])
    return rounded(got.select("city", "scale", F.col("strip").cast("long").alias("strip"), "n_train", "n_test", "r2", "mse", *(F.get("scaled", F.lit(k)).alias(a) for k, a in enumerate(TILE_XS))), 4)


@query()
def f19_f20_forest_shape(i: Inputs) -> DataFrame:
    """Tiles, trees, leaves, depth and their products of the forest of each city and scale."""
    d = order.cut(tile_matrix(i).select("city", "scale", *(F.col(c).cast("double").alias(c) for c in TILE_XS), "y"))
    return forests.shapes(d, ["city", "scale"], TILE_XS)
