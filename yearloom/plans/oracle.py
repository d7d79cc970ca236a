"""The same results as plain SQL, for a second engine to check."""

from __future__ import annotations

from ..roles import REGION_WORDS

MEASURES = ("discharges", "mean_cost", "median_cost", "mean_charge", "median_charge")
MONEY = MEASURES[1:]
KEYS = "facility_id, drg_code, severity_code"
ID = f"{KEYS}, med_surg_code, yr"

PANEL = """
panel as materialized (
  select cast(l_suppkey as varchar) as facility_id,
         concat(s_name, ' ', upper(r_name)) as facility_name,
         regexp_extract(p_brand, '([0-9]+)', 1) as drg_code,
         l_returnflag as severity_code,
         l_linestatus as med_surg_code,
         cast(year(l_shipdate) as int) as yr,
         cast(count(case when l_quantity >= 25 then 1 end) as double) as discharges,
         round(avg(l_quantity * p_retailprice), 6) as mean_cost,
         round(median(l_quantity * p_retailprice), 6) as median_cost,
         round(avg(l_extendedprice), 6) as mean_charge,
         round(median(l_extendedprice), 6) as median_charge
  from lineitem
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  group by 1, 2, 3, 4, 5, 6
)"""

LAGGED = (
    "lagged as (select *, "
    + ", ".join(f"lag({m}) over w as p_{m}" for m in MEASURES)
    + ", lag(discharges, 2) over w as p2_discharges, row_number() over w as pos from panel"
    + f" window w as (partition by {KEYS} order by yr, med_surg_code))"
)
RATIO = {m: f"(({m} - p_{m}) / nullif(p_{m}, 0))" for m in MEASURES}
TREND = "case when pos = 1 then null when p_discharges = 0 then 0.0 else (discharges - p_discharges) / p_discharges end"
CHANGES = (
    "changes as (select *, "
    + ", ".join(f"coalesce({RATIO[m]}, 0.0) as yoy_{m}_change" for m in MEASURES)
    + f", {RATIO['discharges']} as raw_yoy, {TREND} as trend from lagged)"
)
REGION_LIST = "|".join(REGION_WORDS)
REGIONS = f"""
regions as (
  select *, coalesce(nullif(regexp_extract(facility_name, '({REGION_LIST})', 1), ''), 'OTHER') as facility_region
  from panel
),
region_stats as (
  select facility_region, avg(discharges) as region_avg_discharges, median(discharges) as region_median_discharges,
         stddev_samp(discharges) as region_std_discharges
  from regions group by 1
)"""
HOLES = """
holes as (
  select yr, facility_id, drg_code, nullif(severity_code, 'R') as severity_code, med_surg_code, facility_name,
         nullif(discharges, 0.0) as discharges, case when med_surg_code <> 'F' then mean_cost end as mean_cost,
         median_cost, mean_charge, median_charge
  from panel
)"""
INFINITE = """
wild as (
  select yr, facility_id, drg_code, severity_code, med_surg_code, facility_name, discharges,
         case when discharges = 0 then cast('Infinity' as double) else mean_cost end as mean_cost,
         median_cost,
         case when discharges = 0 then cast('-Infinity' as double) else mean_charge end as mean_charge,
         median_charge
  from panel
)"""
COARSE = "select facility_id, drg_code, severity_code, yr, discharges from panel"
MONTHS = "months as (select cast(month(l_shipdate) as int) as mon, concat(l_partkey, '-', l_suppkey) as code from lineitem)"
CODE_COUNTS = """
counts as (select mon, count(distinct code) as n_codes from months group by 1),
moves as (select mon, n_codes, (n_codes - lag(n_codes) over (order by mon)) / lag(n_codes) over (order by mon) as code_change
          from counts)"""
YEARS = "lines as (select *, cast(year(l_shipdate) as int) as yr from lineitem)"
GRID = """
grid as (
  select k.l_partkey, y.yr, coalesce(t.total, 0.0) as total_discharges
  from (select distinct l_partkey from lines) k
  cross join (select distinct yr from lines) y
  left join (select l_partkey, yr, sum(l_quantity) as total from lines group by 1, 2) t
    on t.l_partkey = k.l_partkey and t.yr = y.yr
)"""


def with_panel(select: str, *ctes: str) -> str:
    return "with " + ", ".join([PANEL, *ctes]) + " " + select


def r6(expression: str, name: str | None = None, places: int = 6) -> str:
    return f"round({expression}, {places}) as {name or expression}"


def means(key: str, prefix: str) -> str:
    columns = ", ".join(r6(f"avg({m})", f"{prefix}_avg_{m}", 4) for m in MEASURES)
    return with_panel(f"select {key}, {columns} from panel group by 1")


def describe() -> str:
    one = (
        "select '{c}' as column_name, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
        "round(cast(min({c}) as double), 6) as low, round(quantile_cont(cast({c} as double), 0.25), 6) as p25, "
        "round(quantile_cont(cast({c} as double), 0.5), 6) as p50, round(quantile_cont(cast({c} as double), 0.75), 6) as p75, "
        "round(cast(max({c}) as double), 6) as high from panel"
    )
    return with_panel(" union all ".join(one.format(c=c) for c in ("yr", *MEASURES)))


def null_profile() -> str:
    names = ("yr", "facility_id", "drg_code", "severity_code", "med_surg_code", "facility_name", *MEASURES)
    one = (
        "select '{c}' as column_name, count(*) - count({c}) as n_missing, "
        "round(100.0 * (count(*) - count({c})) / count(*), 6) as pct_missing from holes"
    )
    return with_panel(" union all ".join(one.format(c=c) for c in names), HOLES)


def infinities() -> str:
    one = "select '{c}' as column_name, count(*) filter (where isinf({c})) as n_infinite from wild"
    body = " union all ".join(one.format(c=c) for c in MEASURES)
    return with_panel(f"select * from ({body}) where n_infinite > 0", INFINITE)


PARSE = r"""
with texts as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint) as cents,
         concat('$', cast(cast(round(l_extendedprice * 100) as bigint) // 100000 as varchar), ',',
                lpad(cast((cast(round(l_extendedprice * 100) as bigint) // 100) % 1000 as varchar), 3, '0'), '.',
                lpad(cast(cast(round(l_extendedprice * 100) as bigint) % 100 as varchar), 2, '0')) as pretty
  from lineitem
),
spelled as (
  select *, case when l_linenumber = 1 then concat('"', pretty, '"')
                 when l_linenumber = 2 then concat(cast(cents as varchar), 'd')
                 when l_linenumber = 3 then concat('(', pretty, ')')
                 when l_linenumber = 4 then concat(' ', cast(cents as varchar), 'e-2 ')
                 else pretty end as t
  from texts
),
parsed as (
  select *, try_cast(replace(replace(replace(t, ',', ''), '"', ''), '$', '') as double) as price from spelled
)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(price, 6) as price,
       round(coalesce(price, 0.0), 6) as price_or_zero
from parsed
"""


def bins() -> str:
    """Distinct quantile edges below the value, less the lowest one; every edge is a number of its own."""
    probs = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    edge = lambda c, i: f"quantile_cont({c}, {probs[i]}) as e{i}_{c}"
    stats = [f"stddev_samp({c}) / avg({c}) as cv_{c}" for c in MONEY] + [edge(c, i) for c in MONEY for i in range(6)]

    def below(c: str) -> str:
        rest = [f"case when e{i}_{c} < {c} and e{i}_{c} > e{i - 1}_{c} then 1 else 0 end" for i in range(1, 6)]
        return " + ".join([f"case when e0_{c} < {c} then 1 else 0 end", *rest])

    columns = ", ".join(f"case when cv_{c} > 0.5 then cast(greatest(0, {below(c)} - 1) as int) end as {c}_binned" for c in MONEY)
    return with_panel(
        f"select {ID}, {columns} from panel join edges on edges.one = 1", f"edges as materialized (select 1 as one, {', '.join(stats)} from panel)"
    )


def strict_features() -> str:
    """Means over all rows of earlier years, each key's rows joined with those of the years before."""
    levels = {"facility": ("facility_id", MEASURES), "drg": ("drg_code", MEASURES), "severity": ("severity_code", MEASURES), "key": (KEYS, MEASURES[:1])}
    tables, names = [], []
    for x, (key, measures) in levels.items():
        sums = ", ".join(f"sum({m}) as s_{m}" for m in measures)
        tables.append(f"{x}_sums as (select {key}, yr, count(*) as n, {sums} from panel group by all)")
        mine = [f"{x}_trailing_{m}" for m in measures]
        means = ", ".join(f"sum(s.s_{m}) / sum(s.n) as {c}" for m, c in zip(measures, mine))
        columns = ", ".join(f"r.{k}" for k in key.split(", "))
        same = " and ".join(f"r.{k} = s.{k}" for k in key.split(", "))
        tables.append(f"{x}_before as (select {columns}, r.yr, {means} from {x}_sums r join {x}_sums s on {same} and s.yr < r.yr group by all)")
        names += mine
    tables.append(f"yearly as (select {KEYS}, yr, {', '.join(f'avg({m}) as {m}' for m in MEASURES)} from panel group by all)")
    tables.append(f"""lasts as (
      select {KEYS}, yr, {', '.join(f'lag({m}) over w as last_{m}' for m in MEASURES)}, lag(discharges, 2) over w as last2_discharges
      from yearly window w as (partition by {KEYS} order by yr))""")
    joined = " ".join(f"left join {x}_before using ({key}, yr)" for x, (key, _) in levels.items())
    shown = [*names, *[f"last_{m}" for m in MEASURES], "last2_discharges"]
    return with_panel(
        f"select distinct {KEYS}, yr, {', '.join(f'round({m} + 1e-9, 4) as {m}' for m in MEASURES)}, "
        "case when yr between 2000 and 2001 then 1 else 0 end as covid_period, "
        "case when regexp_matches(drg_code, '^(4|7|13|14)') then 1 else 0 end as respiratory_drg, "
        + ", ".join(f"round(coalesce({c}, 0.0) + 1e-9, 4) as {c}" for c in shown)
        + ", round(coalesce((last_discharges - last2_discharges) / nullif(last2_discharges, 0), 0.0) + 1e-9, 4) as last_change_discharges "
        f"from panel join lasts using ({KEYS}, yr) {joined}",
        *tables,
    )


def caps() -> str:
    stats = ", ".join(
        f"max(abs({m})) as top_{m}, quantile_cont({m}, 0.01) as lo_{m}, quantile_cont({m}, 0.99) as hi_{m}"
        for m in MEASURES
    )
    columns = ", ".join(
        r6(f"case when top_{m} > 5e4 then greatest(lo_{m}, least(hi_{m}, {m})) else {m} end", m) for m in MEASURES
    )
    return with_panel(f"select {ID}, {columns} from panel cross join ends", f"ends as (select {stats} from panel)")


def infinite_to_median() -> str:
    stats = ", ".join(f"median({m}) filter (where not isinf({m})) as mid_{m}" for m in ("mean_cost", "mean_charge"))
    columns = ", ".join(
        r6(f"case when isinf({m}) then mid_{m} else {m} end", m) for m in ("mean_cost", "mean_charge")
    )
    return with_panel(
        f"select {ID}, {columns} from wild cross join mids", INFINITE, f"mids as (select {stats} from wild)"
    )


def naive(select: str) -> str:
    return with_panel(
        select,
        LAGGED,
        """scored as (
          select count(*) as n, avg(power(discharges - coalesce(p_discharges, 0.0), 2)) as mse,
                 avg(abs(discharges - coalesce(p_discharges, 0.0))) as mae, var_pop(discharges) as spread
          from lagged where yr = 1999)""",
    )


def oracle_sql() -> dict[str, str]:
    yoy = [f"yoy_{m}_change" for m in MEASURES]
    shifted = {m: f"greatest(0.0, {m} - 10000)" for m in MONEY} | {"discharges": "greatest(0.0, discharges)"}
    entity_columns = ", ".join(
        r6(f"avg({m}) over (partition by {key})", f"{prefix}_avg_{m}", 4)
        for key, prefix in (("facility_id", "facility"), ("drg_code", "drg"), ("severity_code", "severity"))
        for m in MEASURES
    )
    respiratory = "case when regexp_matches(drg_code, '^(4|7|13|14)') then 1 else 0 end"
    shock = "case when yr between 2000 and 2001 then 1 else 0 end"
    return {
        "a1_panel": with_panel("select * from panel"),
        "b1_shape": with_panel("select count(*) as n_rows, 11 as n_columns from panel"),
        "b2_head": with_panel(f"select * from panel order by {ID} limit 5"),
        "b3_null_profile": null_profile(),
        "b6_year_range": with_panel("select min(yr) as first, max(yr) as last from panel"),
        "b7_describe": describe(),
        "b8_years": with_panel("select distinct yr from panel"),
        "b11_infinities": infinities(),
        "f14_dup_count": with_panel(
            f"select cast(sum(n - 1) as bigint) as n_duplicates from (select count(*) as n from ({COARSE}) group by facility_id, drg_code, severity_code, yr, discharges)"
        ),
        "c3_parse_number": PARSE,
        "c5_mode_impute": with_panel(
            "select facility_id, drg_code, coalesce(severity_code, (select severity_code from holes "
            "where severity_code is not null group by 1 order by count(*) desc, severity_code limit 1)) as severity_code, "
            "med_surg_code, yr, facility_name from holes",
            HOLES,
        ),
        "c6_median_impute": with_panel(
            f"select {ID}, " + ", ".join(
                r6(f"coalesce({c}, (select median({c}) from holes))", c) for c in ("discharges", "mean_cost")
            ) + " from holes",
            HOLES,
        ),
        "i1_dedup": with_panel(COARSE.replace("select", "select distinct", 1)),
        "f1_facility_means": means("facility_id", "facility"),
        "f2_drg_means": means("drg_code", "drg"),
        "f3_severity_means": means("severity_code", "severity"),
        "f4_region_stats": with_panel(
            "select facility_region, round(region_avg_discharges, 6) as region_avg_discharges, "
            "round(region_median_discharges, 6) as region_median_discharges, "
            "round(region_std_discharges, 6) as region_std_discharges from region_stats",
            REGIONS,
        ),
        "f6_codes_per_year": f"with {YEARS} select yr, count(distinct l_partkey) as n_codes from lines group by 1",
        "f10_dispersion": with_panel(
            "select " + ", ".join(r6(f"stddev_samp({m}) / avg({m})", f"cv_{m}") for m in MEASURES) + " from panel"
        ),
        "e1_region_join": with_panel(
            f"select {ID}, facility_region, round(region_avg_discharges, 6) as region_avg_discharges, "
            "round(region_median_discharges, 6) as region_median_discharges, "
            "round(region_std_discharges, 6) as region_std_discharges from regions left join region_stats "
            "using (facility_region)",
            REGIONS,
        ),
        "e2_entity_join": with_panel(f"select {ID}, {entity_columns} from panel"),
        "g1_yoy": with_panel(f"select {ID}, " + ", ".join(r6(c) for c in yoy) + " from changes", LAGGED, CHANGES),
        "g2_lags": with_panel(
            f"select {ID}, round(coalesce(p_discharges, 0.0), 6) as prev_year_discharges, "
            "round(coalesce(p2_discharges, 0.0), 6) as prev2_year_discharges, "
            "round(coalesce(p_mean_cost, 0.0), 6) as prev_year_mean_cost, "
            "round(coalesce(p_median_cost, 0.0), 6) as prev_year_median_cost from lagged",
            LAGGED,
        ),
        "g4_trend": with_panel(
            f"select {ID}, round(trend, 6) as discharge_trend, cast(sign(trend) as double) as discharge_trend_direction "
            "from changes",
            LAGGED, CHANGES,
        ),
        "k1_shock_flag": with_panel(f"select {ID}, {shock} as covid_period from panel"),
        "k2_season_flag": (
            f"with {YEARS} select yr, cast(month(l_shipdate) as int) as mon, {shock} as covid_period, "
            "case when month(l_shipdate) in (1, 2, 3, 10, 11, 12) then 1 else 0 end as flu_season, count(*) as n_rows "
            "from lines group by all"
        ),
        "k3_prefix_flag": with_panel(f"select {ID}, {respiratory} as respiratory_drg from panel"),
        "k4_growth": with_panel(
            f"select {ID}, case when raw_yoy > 0 and trend > 0 then 1 when raw_yoy < 0 and trend < 0 then -1 else 0 end "
            "as consistent_growth from changes",
            LAGGED, CHANGES,
        ),
        "j8_interactions": with_panel(
            f"select {ID}, ({shock}) * ({respiratory}) as covid_respiratory_impact, "
            f"round(p_discharges * ({shock}), 6) as prev_year_impact from lagged",
            LAGGED,
        ),
        "k5_swap": with_panel(
            f"select {ID}, case when mean_cost > mean_charge * 1.5 then mean_charge else mean_cost end as mean_cost, "
            "case when mean_cost > mean_charge * 1.5 then mean_cost else mean_charge end as mean_charge, "
            "case when mean_cost > mean_charge then 1 else 0 end as illogical_cost_charge from panel"
        ),
        "k5_swap_counts": with_panel(
            "select count(*) filter (where mean_cost > mean_charge) as n_illogical, "
            "count(*) filter (where mean_cost > mean_charge * 1.5) as n_severe from panel"
        ),
        "k6_unusual": with_panel(
            f"select {ID}, " + ", ".join(
                f"case when yoy_{m}_change < -0.5 then -1 when yoy_{m}_change > 1.0 then 1 else 0 end as unusual_{m}_change"
                for m in MEASURES[:3]
            ) + " from changes",
            LAGGED, CHANGES,
        ),
        "k6_unusual_counts": with_panel(
            " union all ".join(
                f"select '{c}' as column_name, count(*) filter (where {c} > 1.0) as n_up, "
                f"count(*) filter (where {c} < -0.5) as n_down from changes"
                for c in yoy
            ),
            LAGGED, CHANGES,
        ),
        "k7_winsorise": with_panel(
            f"select {ID}, round(greatest(lo, least(hi, yoy_discharges_change)), 6) as yoy_discharges_change "
            "from changes cross join ends",
            LAGGED, CHANGES,
            "ends as (select quantile_cont(yoy_discharges_change, 0.01) as lo, "
            "quantile_cont(yoy_discharges_change, 0.99) as hi from changes)",
        ),
        "k8_clip_negative": with_panel(
            f"select {ID}, " + ", ".join(r6(e, m) for m, e in shifted.items()) + " from panel"
        ),
        "k8_negative_counts": with_panel(
            "select " + ", ".join(
                f"count(*) filter (where {m}{' - 10000' if m in MONEY else ''} < 0) as n_negative_{m}" for m in MEASURES
            ) + " from panel"
        ),
        "k9_coding_change": (
            f"with {MONTHS}, {CODE_COUNTS} select mon, case when mon > coalesce((select max(mon) from moves "
            "where abs(code_change) > 0.1), 99) then 1 else 0 end as post_drg_change, count(*) as n_rows "
            "from months group by all"
        ),
        "g6_code_change": (
            f"with {MONTHS}, {CODE_COUNTS} select mon, n_codes, round(code_change, 6) as code_change from moves"
        ),
        "k10_bins": bins(),
        "k11_cap": caps(),
        "k11_infinite": infinite_to_median(),
        "f5_dense_totals": (
            f"with {YEARS}, {GRID} select l_partkey, yr, round(total_discharges, 6) as total_discharges from grid"
        ),
        "g5_totals_yoy": (
            f"with {YEARS}, {GRID}, steps as (select *, lag(total_discharges) over (partition by l_partkey order by yr) as p "
            "from grid) select l_partkey, yr, round(total_discharges, 6) as total_discharges, "
            "round(coalesce(p, 0.0), 6) as prev_year_discharges, "
            "round(coalesce((total_discharges - p) / nullif(p, 0), 0.0), 6) as yoy_change from steps"
        ),
        "k12_test_year": with_panel(
            "select coalesce(max(case when yr = 1999 then yr end), max(case when yr < 2000 then yr end), "
            "min(case when yr >= 2000 then yr end)) as test_time from panel"
        ),
        "k13_split_counts": with_panel(
            "select 'train' as part, count(*) as n_rows, min(yr) as first, max(yr) as last from panel where yr < 1999 "
            "union all select 'test', count(*), min(yr), max(yr) from panel where yr = 1999"
        ),
        "l1_one_hot": with_panel(
            f"select {ID}, case when severity_code = 'N' then 1 else 0 end as \"severity_code_N\", "
            "case when severity_code = 'R' then 1 else 0 end as \"severity_code_R\", "
            "case when med_surg_code = 'O' then 1 else 0 end as \"med_surg_code_O\" from panel"
        ),
        "m2_strict_features": strict_features(),
        "m2_strict_totals": (
            f"with {YEARS}, {GRID}, steps as (select *, lag(total_discharges) over w as p, lag(total_discharges, 2) over w as p2 "
            "from grid window w as (partition by l_partkey order by yr)) select l_partkey, yr, round(total_discharges, 6) as total_discharges, "
            "round(coalesce(p, 0.0), 6) as prev_year_discharges, round(coalesce((p - p2) / nullif(p2, 0), 0.0), 6) as yoy_change from steps"
        ),
        "l3_code_positions": with_panel(
            "select drg_code, yr, round(coalesce(total, 0.0), 6) as total_discharges, nullif(slot, 0) - 1 as hot_position "
            "from (select drg_code, row_number() over (order by drg_code) - 1 as slot from (select distinct drg_code from panel)) "
            "cross join (select distinct yr from panel) "
            "left join (select drg_code, yr, sum(discharges) as total from panel group by 1, 2) using (drg_code, yr)"
        ),
        "e6_code_vectors": with_panel(
            "select drg_code, yr, round(label, 6) as label, feature_index, feature, round(cast(value as double), 6) as value from ("
            + " union all ".join(
                f"select drg_code, yr, label, {i} as feature_index, '{f}' as feature, {f} as value from steps"
                for i, f in enumerate(("yr", "prev_year_discharges", "yoy_change"))
            )
            + " union all select s.drg_code, s.yr, s.label, 2 + c.slot, 'drg_code_' || c.drg_code, case when s.drg_code = c.drg_code then 1 else 0 end "
            "from steps s cross join codes c where c.slot > 0)",
            "codes as (select drg_code, row_number() over (order by drg_code) - 1 as slot from (select distinct drg_code from panel))",
            "filled as (select drg_code, yr, coalesce(total, 0.0) as label from codes cross join (select distinct yr from panel) "
            "left join (select drg_code, yr, sum(discharges) as total from panel group by 1, 2) using (drg_code, yr))",
            "steps as (select drg_code, yr, label, coalesce(p, 0.0) as prev_year_discharges, coalesce((label - p) / nullif(p, 0), 0.0) as yoy_change "
            "from (select *, lag(label) over (partition by drg_code order by yr) as p from filled))",
        ),
        "j4_text_keys": with_panel(
            f"select {ID}, concat_ws('_', facility_id, drg_code, severity_code) as facility_drg_key, cast(yr as varchar) as year_cat from panel"
        ),
        "l2_unknown_category": (
            f"with {YEARS}, seen as (select l_partkey, row_number() over (order by cast(l_partkey as varchar)) - 1 as slot "
            "from (select distinct l_partkey from lines where yr < 1996)) "
            "select l_partkey, yr, count(*) as n_rows, nullif(max(slot), 0) - 1 as hot_position "
            "from lines left join seen using (l_partkey) group by 1, 2"
        ),
        "l4_features": with_panel(
            f"select {KEYS}, yr, 42 * count(*) as n_values, round(42 * sum(discharges), 6) as label_sum from panel "
            f"group by {KEYS}, yr"
        ),
        "m5_metrics": naive(
            "select n, round(sqrt(mse), 6) as rmse, round(mae, 6) as mae, round(1 - mse / spread, 6) as r2 from scored"
        ),
        "j12_report_text": naive(
            "select 'previous year' as \"Task\", printf('%.2f', sqrt(mse)) as \"RMSE\", printf('%.2f', mae) as \"MAE\", "
            "printf('%.4f', 1 - mse / spread) as r2_text from scored"
        ),
        "o1_roll_forward": with_panel(
            f"select {KEYS}, med_surg_code, 2000 as yr, " + ", ".join(MEASURES) + " from panel where yr = 1999"
        ),
        "o2_mean_yoy": with_panel(
            "select " + ", ".join(r6(f"avg({c})", c) for c in yoy) + " from changes where yr >= 1997", LAGGED, CHANGES
        ),
        "o3_align": with_panel(
            f"select {KEYS}, med_surg_code, 2000 as yr, discharges, mean_cost, "
            "(select round(avg(yoy_discharges_change), 6) from changes where yr >= 1997) as yoy_discharges_change, "
            "(select round(avg(yoy_mean_cost_change), 6) from changes where yr >= 1997) as yoy_mean_cost_change, "
            "cast(0.0 as double) as absent_feature from changes where yr = 1999",
            LAGGED, CHANGES,
        ),
        "p1_charge_cost_ratio": with_panel(
            "select facility_id, round(sum(mean_charge) / nullif(sum(mean_cost), 0), 6) as charge_to_cost from panel group by 1"
        ),
        "p2_cost_charge_corr": with_panel(
            "select facility_id, round(case when stddev_pop(mean_cost) > 0 and stddev_pop(mean_charge) > 0 "
            "then corr(mean_cost, mean_charge) end, 6) as cost_charge_corr from panel group by 1"
        ),
    }
