"""The same queries as SQL text for another engine.

Dispatch is written as a running sum over resources in merit order, and the previous level as a
window over the whole series: both differ from the way the library does it.
"""

from __future__ import annotations

from wattframe.catalog.queries import FIXTURE_MAP, GRID, SIMULATED, STUDY_CODES, STUDY_PLACE
from wattframe.operators.results import VARIABLES
from wattframe.plans import comparison
from wattframe.plans.categories import MODELS, SCENARIOS, TYPICAL_DAYS
from wattframe.plans.sweep import STUDY

ORACLE: dict[str, str] = {}

VALUES = ("demand", "windOnshore", "windOffshore", "solar")
NAMED = ("Demand", "WindOnshore", "WindOffshore", "Solar", "Wind")
AMOUNTS = (
    "nuclear",
    "renewable",
    "netStorage",
    "demand",
    "energyNotServed",
    "storageLevel",
    "curtailNuclear",
    "curtailRenewable",
)


def r(expression: str, alias: str, digits: int = 6) -> str:
    return f'round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS "{alias}"'


def rs(columns, digits: int = 6) -> str:
    return ", ".join(r(f'"{c}"', c, digits) for c in columns)


def text(expression: str, alias: str) -> str:
    return f'CAST({expression} AS VARCHAR) AS "{alias}"'


def amount(column: str, condition: str | None = None) -> str:
    where = f" FILTER (WHERE {condition})" if condition else ""
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))){where} AS DOUBLE)"


def even(expression: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"CAST(round_even(({expression}) * {scale}, 0) AS DOUBLE) / {scale}"


EVENTS = f"""
hourly_events AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'SOUTH' ELSE 'NORTH' END AS country,
    date_trunc('hour', ts) AS "dateTime",
    {amount('value', "event_type IN ('click', 'error')")} AS demand,
    {amount('value', "event_type = 'view'")} AS "windOnshore",
    {amount('value', "event_type = 'purchase'")} AS "windOffshore",
    {amount('value', "event_type = 'signup'")} AS solar
  FROM events GROUP BY 1, 2)
"""
READINGS = """
readings AS (
  SELECT r_name AS country, l_shipdate + to_hours(l_orderkey % 24) AS "dateTime",
    l_returnflag, l_linestatus, l_quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
SHIPMENTS = f"""{READINGS},
hourly_shipments AS (
  SELECT country, "dateTime",
    {amount('l_quantity')} AS demand,
    {amount('l_quantity', "l_returnflag = 'A'")} AS "windOnshore",
    {amount('l_quantity', "l_returnflag = 'R' AND l_linestatus = 'O'")} AS "windOffshore",
    {amount('l_quantity', "l_returnflag = 'N'")} AS solar
  FROM readings GROUP BY 1, 2)
"""
CAPACITY = """
highest AS (
  SELECT country, CAST(year("dateTime") AS INTEGER) AS year, max("windOnshore") AS "windOnshore",
    max("windOffshore") AS "windOffshore", max(solar) AS solar
  FROM hourly_shipments GROUP BY 1, 2),
capacity AS (SELECT * FROM highest)
"""


def generation(source: str) -> str:
    return f"""
generation AS (
  SELECT country, CAST(year("dateTime") AS INTEGER) AS year, "dateTime", demand AS "Demand",
    "windOnshore" AS "WindOnshore", "windOffshore" AS "WindOffshore", solar AS "Solar",
    coalesce("windOffshore", 0) + coalesce("windOnshore", 0) AS "Wind"
  FROM {source}
  WHERE "dateTime" <= make_timestamp(year("dateTime"), 12, 31, 23, 0, 0))
"""


def normalised(keys: str, total: str = 'sum("Demand")') -> str:
    return f"""
totals AS (
  SELECT {keys}, sum("Wind") AS w, sum("Solar") AS s, sum("Demand") AS d, count(*) AS n,
    CAST({total} AS DOUBLE) AS level
  FROM generation GROUP BY ALL),
normalised AS (
  SELECT {keys}, "dateTime", "Wind" / nullif(w, 0) * level * 0.5 AS "Wind",
    "Solar" / nullif(s, 0) * level * 0.3 AS "Solar", CAST(1 AS DOUBLE) / n * level * 0.2 AS "Constant",
    "Demand" / nullif(d, 0) * level AS "Demand"
  FROM generation JOIN totals USING ({keys}))
"""


BALANCE = """
supplied AS (
  SELECT *, coalesce("Wind", 0) + coalesce("Solar", 0) + coalesce("Constant", 0) AS "TotalSupply"
  FROM normalised),
balance AS (
  SELECT *,
    CASE WHEN "Demand" IS NOT NULL THEN greatest("TotalSupply" - "Demand", 0) END AS "ExcessSupply",
    CASE WHEN "Demand" IS NOT NULL THEN greatest("Demand" - "TotalSupply", 0) END AS "ExcessDemand"
  FROM supplied)
"""
EVENT_BALANCE = f"{EVENTS}, {generation('hourly_events')}, {normalised('country')}, {BALANCE}"
YEAR_NORMALISED = f"{SHIPMENTS}, {generation('hourly_shipments')}, {normalised('country, year')}"
YEAR_BALANCE = f"{YEAR_NORMALISED}, {BALANCE}"

TIME = text('"dateTime"', "dateTime")

# ---- sources, projections, filters

ORACLE["scan_country_period"] = f"""
WITH {SHIPMENTS}
SELECT country, {TIME}, {rs(VALUES)} FROM hourly_shipments
WHERE country = 'EUROPE'
  AND "dateTime" BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1998-08-31 23:00:00'
"""
ORACLE["scan_calendar_year"] = f"""
WITH {SHIPMENTS}, {generation('hourly_shipments')}
SELECT country, year, {TIME}, {rs(NAMED)} FROM generation WHERE country = 'EUROPE' AND year = 1999
"""
ORACLE["country_list"] = f"""
WITH {SHIPMENTS}, {CAPACITY} SELECT DISTINCT country FROM capacity ORDER BY country
"""
ORACLE["rename_capitalised"] = f"""
WITH {SHIPMENTS}, {generation('hourly_shipments')}
SELECT country, {TIME}, {rs(NAMED[:4])} FROM generation
"""
ORACLE["wind_total"] = f"""
WITH {SHIPMENTS}, {generation('hourly_shipments')}
SELECT country, {TIME}, {rs(['Wind'])} FROM generation
"""

# ---- normalised profiles and balance

SHARED = ("Wind", "Solar", "Constant", "Demand")
ORACLE["normalize_generation"] = f"""
WITH {EVENTS}, {generation('hourly_events')}, {normalised('country')}
SELECT country, {TIME}, {rs(SHARED)} FROM normalised
"""
ORACLE["normalize_to_total"] = f"""
WITH {SHIPMENTS}, {generation('hourly_shipments')}, {normalised('country, year', '100000')}
SELECT country, year, {TIME}, {rs(SHARED)} FROM normalised
"""
ORACLE["storage_hourly"] = f"""
WITH {EVENT_BALANCE}
SELECT country, {TIME}, {rs([*SHARED, 'TotalSupply', 'ExcessSupply', 'ExcessDemand'])} FROM balance
"""


def stats(keys: str) -> str:
    def one(m: str) -> str:
        total = f'coalesce(sum("{m}"), 0)'
        share = f'CASE WHEN coalesce(sum("Demand"), 0) <> 0 THEN {total} / sum("Demand") * 100 ELSE 0 END'
        hours = f'count(*) FILTER (WHERE "{m}" > 9)'
        return f"""
  SELECT {keys}, '{m}' AS measure, {even(total, 1)} AS "Total",
    {even(share, 1)} AS "TotalPercentOfDemand", {even(f'max("{m}")', 1)} AS "Max",
    CAST({hours} AS DOUBLE) AS "Hours"
  FROM balance GROUP BY {keys}"""

    return f"stats AS ({one('ExcessSupply')} UNION ALL {one('ExcessDemand')})"


STATISTICS = ("Total", "TotalPercentOfDemand", "Max", "Hours")
ORACLE["storage_stats"] = f"""
WITH {EVENT_BALANCE}, {stats('country')} SELECT country, measure, {rs(STATISTICS)} FROM stats
"""
ORACLE["storage_stats_by_year"] = f"""
WITH {YEAR_BALANCE}, {stats('country, year')}
SELECT country, year, measure, {rs(STATISTICS)} FROM stats
"""
ORACLE["storage_stats_transposed"] = f"""
WITH {YEAR_BALANCE}, {stats('country, year')},
long AS (
  UNPIVOT stats ON "Total", "TotalPercentOfDemand", "Max", "Hours" INTO NAME statistic VALUE v)
SELECT country, year, statistic,
  {r("max(v) FILTER (WHERE measure = 'ExcessSupply')", 'ExcessSupply')},
  {r("max(v) FILTER (WHERE measure = 'ExcessDemand')", 'ExcessDemand')}
FROM long GROUP BY country, year, statistic
"""

# ---- profiles, bins, stacking


def means(columns) -> str:
    return ", ".join(r(f'avg("{c}")', c) for c in columns)


SEASON = """
CASE WHEN month("dateTime") IN (3, 4, 5) THEN 'Spring' WHEN month("dateTime") IN (6, 7, 8) THEN 'Summer'
  WHEN month("dateTime") IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END
"""


def six(source: str, keys: str, columns) -> str:
    avgs = ", ".join(f'avg("{c}") AS "{c}"' for c in columns)
    return f"""
six AS (
  SELECT {keys}, 'Hourly: Year' AS profile, hour("dateTime") AS x, {avgs} FROM {source} GROUP BY ALL
  UNION ALL
  SELECT {keys}, 'Monthly', month("dateTime"), {avgs} FROM {source} GROUP BY ALL
  UNION ALL
  SELECT {keys}, 'Hourly: ' || {SEASON}, hour("dateTime"), {avgs} FROM {source} GROUP BY ALL)
"""


ORACLE["hour_profile"] = f"""
WITH {SHIPMENTS}
SELECT country, CAST(hour("dateTime") AS INTEGER) AS hour, {means(VALUES)}
FROM hourly_shipments GROUP BY 1, 2
"""
ORACLE["month_profile"] = f"""
WITH {SHIPMENTS}
SELECT country, CAST(month("dateTime") AS INTEGER) AS month, {means(VALUES)}
FROM hourly_shipments GROUP BY 1, 2
"""
ORACLE["season_profiles"] = f"""
WITH {SHIPMENTS}
SELECT country, {SEASON} AS season, CAST(hour("dateTime") AS INTEGER) AS hour, {means(VALUES)}
FROM hourly_shipments GROUP BY 1, 2, 3
"""
ORACLE["all_profiles"] = f"""
WITH {SHIPMENTS}, {six('hourly_shipments', 'country', VALUES)}
SELECT country, profile, CAST(x AS INTEGER) AS x, {rs(VALUES)} FROM six
"""
ORACLE["stacked_profile"] = f"""
WITH {YEAR_NORMALISED}, {six('normalised', 'country, year', SHARED)}
SELECT country, year, profile, CAST(x AS INTEGER) AS x, {r('"Demand"', 'Demand')},
  {r('"Constant" + "Wind"', 'Wind')}, {r('"Constant" + "Wind" + "Solar"', 'Solar')},
  {r('"Constant"', 'Constant')}
FROM six
"""


def binned(source: str, keys: str, days: int, columns) -> str:
    sums = ", ".join(f'coalesce(sum("{c}"), 0) AS "{c}"' for c in columns)
    return f"""
spans AS (
  SELECT {keys}, min(CAST("dateTime" AS DATE)) AS d0, max(CAST("dateTime" AS DATE)) AS d1
  FROM {source} GROUP BY ALL),
starts AS (
  SELECT {keys}, d0, unnest(generate_series(0, date_diff('day', d0, d1) // {days})) AS b FROM spans),
binned AS (
  SELECT {keys}, CAST(d0 + CAST(b * {days} AS INTEGER) AS TIMESTAMP) AS "dateTime", {sums}
  FROM starts LEFT JOIN (
    SELECT *, date_diff('day', d0, CAST("dateTime" AS DATE)) // {days} AS b
    FROM {source} JOIN spans USING ({keys})) AS hours USING ({keys}, d0, b)
  GROUP BY {keys}, d0, b)
"""


for _name, _days in (("resample_days", 3), ("resample_single_days", 1)):
    ORACLE[_name] = f"""
WITH {SHIPMENTS}, {binned('hourly_shipments', 'country', _days, VALUES)}
SELECT country, {TIME}, {rs(VALUES)} FROM binned
"""
ORACLE["resample_days_percent"] = f"""
WITH {YEAR_NORMALISED}, {binned('normalised', 'country, year', 1, SHARED)}
SELECT country, year, {TIME},
  {', '.join(r(f'"{c}" / nullif("Demand", 0) * 100', c) for c in SHARED)}
FROM binned
"""
ORACLE["first_day"] = f"""
WITH {YEAR_BALANCE}
SELECT country, year, {TIME}, {rs(['ExcessSupply', 'ExcessDemand'])} FROM balance
QUALIFY row_number() OVER (PARTITION BY country, year ORDER BY "dateTime") <= 24
"""
_COUNTED = {
    "country": "string",
    "dateTime": "timestamp_ntz",
    **{c: "double" for c in (*SHARED, "TotalSupply", "ExcessSupply", "ExcessDemand")},
}
ORACLE["column_counts"] = f"WITH {EVENT_BALANCE}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(\"{c}\") AS present FROM balance"
    for c, kind in _COUNTED.items()
)
ORACLE["duplicate_hours"] = f"""
WITH {READINGS}
SELECT country, {TIME}, count(*) AS n FROM readings GROUP BY country, "dateTime" HAVING count(*) > 1
"""

# ---- capacity


def capacity_stats(capacity: str) -> str:
    annual = " UNION ALL ".join(
        f"SELECT country, year, '{c}' AS technology, coalesce(sum(\"{c}\"), 0) AS \"AnnualGeneration\","
        f' sum("Demand") AS d FROM generation GROUP BY country, year'
        for c in NAMED
    )
    cells = {
        "WindOnshore": '"windOnshore"',
        "WindOffshore": '"windOffshore"',
        "Solar": "solar",
        "Wind": 'coalesce("windOffshore", 0) + coalesce("windOnshore", 0)',
    }
    installed = " UNION ALL ".join(
        f"SELECT country, year, '{c}' AS technology, {e} AS \"Capacity\" FROM {capacity}"
        for c, e in cells.items()
    )
    return f"""
annual AS ({annual}),
installed AS ({installed}),
capacity_stats AS (
  SELECT country, year, technology, "Capacity", "AnnualGeneration",
    "AnnualGeneration" / nullif("Capacity", 0) AS "FullloadHours",
    100 * "AnnualGeneration" / nullif(d, 0) AS "DemandShare"
  FROM annual FULL JOIN installed USING (country, year, technology))
"""


CAPACITY_STATS = (
    f"{SHIPMENTS}, {CAPACITY}, {generation('hourly_shipments')}, {capacity_stats('capacity')}"
)
FIGURES = ("Capacity", "AnnualGeneration", "FullloadHours", "DemandShare")
ORACLE["capacity_stats"] = f"""
WITH {CAPACITY_STATS} SELECT country, year, technology, {rs(FIGURES)} FROM capacity_stats
"""
ORACLE["empty_source"] = f"""
WITH {SHIPMENTS}, {CAPACITY}, {generation('hourly_shipments')},
none AS (SELECT * FROM capacity WHERE false), {capacity_stats('none')}
SELECT country, year, technology, {rs(FIGURES)} FROM capacity_stats
"""
_OVERVIEW = {
    "Capacity [GW]": '"Capacity" / 1000',
    "Annual Gen. [TWh]": '"AnnualGeneration" / 1000000',
    "Fullload Hours [#]": '"FullloadHours"',
    "Demand Share [%]": '"DemandShare"',
}


def _overview(name: str, e: str) -> str:
    wind, solar = (
        r(even(f"max({e}) FILTER (WHERE technology = '{t}')", 0), t) for t in ("Wind", "Solar")
    )
    return (
        f"SELECT country, year, '{name}' AS figure, {wind}, {solar}"
        " FROM capacity_stats GROUP BY country, year"
    )


ORACLE["observed_overview"] = f"WITH {CAPACITY_STATS}\n" + "\nUNION ALL\n".join(
    _overview(name, e) for name, e in _OVERVIEW.items()
)
ORACLE["implied_capacity"] = ORACLE["implied_from_stats"] = f"""
WITH {CAPACITY_STATS}, {normalised('country, year')},
sums AS (
  SELECT country, year, 'Wind' AS technology, sum("Wind") AS g FROM normalised GROUP BY 1, 2
  UNION ALL SELECT country, year, 'Solar', sum("Solar") FROM normalised GROUP BY 1, 2)
SELECT country, year, technology,
  {r(even('g / ("FullloadHours" + 0.0000001) / 1000', 2), 'impliedCapacity')}
FROM sums JOIN capacity_stats USING (country, year, technology)
"""

# ---- scenarios and dispatch

ORACLE["circular_lag"] = f"""
WITH {SHIPMENTS}
SELECT country, {TIME}, {rs(['demand', 'windOnshore'])},
  {', '.join(r(f'''CASE WHEN row_number() OVER w = 1
    THEN last_value("{c}") OVER (PARTITION BY country ORDER BY "dateTime"
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    ELSE lag("{c}") OVER w END''', f'previous_{c}') for c in ('demand', 'windOnshore'))}
FROM hourly_shipments WINDOW w AS (PARTITION BY country ORDER BY "dateTime")
"""


def scenario_rows(grid: dict) -> str:
    def level(name: str, values) -> str:
        rows = ", ".join(f"({i}, CAST('{v}' AS DOUBLE))" for i, v in enumerate(values))
        return f"(VALUES {rows}) AS {name}(i_{name}, {name})"

    costs = ", ".join(
        f"({i}, {float(c.get('nuclear', 0))}::DOUBLE, {float(c.get('renewable', 0))}::DOUBLE)"
        for i, c in enumerate(grid["cost_curtailment"])
    )
    n_gen, n_sto, n_cost = (
        len(grid[k]) for k in ("share_generation", "share_storage", "cost_curtailment")
    )
    return f"""
scenarios AS (
  SELECT CAST(((i_ren * {n_gen} + i_gen) * {n_sto} + i_sto) * {n_cost} + i_cost AS INTEGER) AS scenario_id,
    gen AS share_generation, ren AS share_renewable, sto AS share_storage,
    cn AS "costCurtailNuclear", cr AS "costCurtailRenewable"
  FROM {level('ren', grid['share_renewable'])}, {level('gen', grid['share_generation'])},
    {level('sto', grid['share_storage'])}, (VALUES {costs}) AS cost(i_cost, cn, cr))
"""


def dispatched(source: str, grid: dict, renewable: str = "windOnshore", total: str = "sum_demand") -> str:
    return f"""
sizes AS (
  SELECT country, sum(coalesce(demand, 0)) AS sum_demand,
    sum(coalesce("{renewable}", 0)) AS sum_renewable, count(*) AS n
  FROM {source} GROUP BY country),
{scenario_rows(grid)},
cells AS (
  SELECT country, "dateTime" AS date, s.*,
    coalesce(coalesce(demand, 0) / nullif(sum_demand, 0), 0) * CAST({total} AS DOUBLE) AS dem,
    CAST(1 AS DOUBLE) / n * (share_generation * CAST({total} AS DOUBLE) * (1 - share_renewable)) AS pot_n,
    coalesce(coalesce("{renewable}", 0) / nullif(sum_renewable, 0), 0)
      * (share_generation * CAST({total} AS DOUBLE) * share_renewable) AS pot_r,
    CAST({total} AS DOUBLE) * share_storage AS size
  FROM {source} JOIN sizes USING (country), scenarios AS s),
resources AS (
  SELECT country, date, scenario_id, dem, 'n' AS name, pot_n AS cap, -"costCurtailNuclear" AS mc, 0 AS p FROM cells
  UNION ALL
  SELECT country, date, scenario_id, dem, 'r', pot_r, -"costCurtailRenewable", 1 FROM cells
  UNION ALL
  SELECT country, date, scenario_id, dem, 's', size, 0, 2 FROM cells
  UNION ALL
  SELECT country, date, scenario_id, dem, 'u', 1e300, 1, 3 FROM cells),
filled AS (
  SELECT *, greatest(0, least(cap, dem - coalesce(sum(cap) OVER (
    PARTITION BY country, scenario_id, date ORDER BY mc, p
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used
  FROM resources),
taken AS (
  SELECT country, scenario_id, date, max(used) FILTER (WHERE name = 'n') AS nuclear,
    max(used) FILTER (WHERE name = 'r') AS renewable, max(used) FILTER (WHERE name = 's') AS level,
    max(used) FILTER (WHERE name = 'u') AS ens
  FROM filled GROUP BY 1, 2, 3),
solved AS (
  SELECT country, scenario_id, date, nuclear, renewable,
    CASE WHEN row_number() OVER w = 1 THEN last_value(level) OVER (
      PARTITION BY country, scenario_id ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(level) OVER w END
      - level AS "netStorage",
    dem AS demand, ens AS "energyNotServed", level AS "storageLevel",
    pot_n - nuclear AS "curtailNuclear", pot_r - renewable AS "curtailRenewable",
    share_generation, share_renewable, share_storage, "costCurtailNuclear", "costCurtailRenewable"
  FROM taken JOIN cells USING (country, scenario_id, date)
  WINDOW w AS (PARTITION BY country, scenario_id ORDER BY date))
"""


ATTRIBUTES = (
    "share_generation",
    "share_renewable",
    "share_storage",
    "costCurtailNuclear",
    "costCurtailRenewable",
)
DATE = text("date", "date")
DISPATCH = f"{EVENTS}, {dispatched('hourly_events', GRID)}"


def summed(source: str = "solved", name: str = "summed") -> str:
    return f"""
{name} AS (
  SELECT country, scenario_id, {', '.join(f'max("{c}") AS "{c}"' for c in ATTRIBUTES)},
    {', '.join(f'sum("{c}") AS "{c}"' for c in AMOUNTS)},
    sum("energyNotServed" + "costCurtailNuclear" * "curtailNuclear"
      + "costCurtailRenewable" * "curtailRenewable") AS objective
  FROM {source} GROUP BY country, scenario_id)
"""


TOTALS = f"country, scenario_id, {rs(ATTRIBUTES)}, {rs([*AMOUNTS, 'objective'], 4)}"

ORACLE["scenario_grid"] = f"""
WITH {SHIPMENTS}, {scenario_rows(GRID)},
sizes AS (SELECT country, sum(demand) AS d FROM hourly_shipments GROUP BY 1)
SELECT country, scenario_id, {rs(ATTRIBUTES)},
  {r('share_generation * d * (1 - share_renewable)', 'energyNuclear')},
  {r('share_generation * d * share_renewable', 'energyRenewable')},
  {r('d * share_storage', 'storageSize')}, {r('d', 'totalDemand')}
FROM sizes, scenarios
"""
ORACLE["scenario_inputs"] = f"""
WITH {EVENTS},
sizes AS (
  SELECT country, sum(demand) AS d, sum("windOnshore") AS w, count(*) AS n FROM hourly_events GROUP BY 1),
long AS (
  SELECT country, "dateTime" AS date, 'alpha' AS symbol, 'nuclear' AS element,
    CAST(1 AS DOUBLE) / n AS value FROM hourly_events JOIN sizes USING (country)
  UNION ALL
  SELECT country, "dateTime", 'alpha', 'renewable', "windOnshore" / w
  FROM hourly_events JOIN sizes USING (country)
  UNION ALL
  SELECT country, "dateTime", 'dem', NULL, demand / d * 100000
  FROM hourly_events JOIN sizes USING (country))
SELECT country, {DATE}, symbol, element, {rs(['value'])} FROM long WHERE value IS NOT NULL
"""
ORACLE["dispatch_hourly"] = f"""
WITH {DISPATCH} SELECT country, scenario_id, {DATE}, {rs([*AMOUNTS, *ATTRIBUTES])} FROM solved
"""
ORACLE["dispatch_totals"] = f"WITH {DISPATCH}, {summed()} SELECT {TOTALS} FROM summed"
ORACLE["sweep_totals"] = f"""
WITH {SHIPMENTS}, {dispatched('hourly_shipments', GRID, 'solar')}, {summed()}
SELECT {TOTALS} FROM summed
"""
ORACLE["sweep_study"] = f"""
WITH {EVENTS}, {dispatched('hourly_events', STUDY, total='100000')}, {summed()}
SELECT {TOTALS} FROM summed
"""
ORACLE["result_join"] = ORACLE["dispatch_hourly"]
_SOLAR = dispatched("hourly_events", GRID, "solar")
ORACLE["union_scenarios"] = f"""
WITH wind AS (WITH {DISPATCH}, {summed()} SELECT * FROM summed),
sun AS (WITH {EVENTS}, {_SOLAR}, {summed()} SELECT * EXCLUDE (objective) FROM summed),
both_runs AS (
  SELECT *, 'windOnshore' AS source FROM wind UNION ALL BY NAME SELECT *, 'solar' AS source FROM sun)
SELECT {TOTALS}, source FROM both_runs
"""
ORACLE["write_results"] = f"""
WITH {DISPATCH} SELECT country, scenario_id, {DATE}, {rs([*AMOUNTS, *ATTRIBUTES])} FROM solved
"""

MIXED = f"""{EVENTS},
mixed AS (
  SELECT country, "dateTime",
    coalesce(demand, 0) - 2 * CASE WHEN country = 'SOUTH' THEN coalesce("windOffshore", 0) ELSE 0 END AS demand,
    coalesce("windOnshore", 0) - coalesce(solar, 0) AS "windOnshore"
  FROM hourly_events),
{dispatched('mixed', GRID)},
reasons AS (
  SELECT country, scenario_id, {', '.join(f'max("{c}") AS "{c}"' for c in ATTRIBUTES)},
    concat_ws(', ', CASE WHEN min(dem) < 0 THEN 'negative demand' END,
      CASE WHEN min(pot_n) < 0 THEN 'negative nuclear potential' END,
      CASE WHEN min(pot_r) < 0 THEN 'negative renewable potential' END,
      CASE WHEN min(size) < 0 THEN 'negative storage size' END) AS reason
  FROM cells GROUP BY country, scenario_id),
feasible AS (
  SELECT solved.* FROM solved JOIN reasons USING (country, scenario_id) WHERE reason = '')
"""
ORACLE["rejected_scenarios"] = f"""
WITH {MIXED} SELECT country, scenario_id, {rs(ATTRIBUTES)}, reason FROM reasons WHERE reason <> ''
"""
ORACLE["feasible_totals"] = f"WITH {MIXED}, {summed('feasible')} SELECT {TOTALS} FROM summed"
_FIRST, _LAST = (SIMULATED[k].replace("/", "-") for k in ("start", "end"))
ORACLE["simulated"] = ORACLE["resumed_sweep"] = f"""
WITH {EVENTS},
chosen AS (
  SELECT * FROM hourly_events WHERE country = '{SIMULATED["country"]}'
    AND "dateTime" BETWEEN TIMESTAMP '{_FIRST}:00' AND TIMESTAMP '{_LAST}:00'),
{dispatched('chosen', GRID)}
SELECT country, scenario_id, {DATE}, {rs([*AMOUNTS, *ATTRIBUTES])} FROM solved
"""

# ---- scenario results

FLAGGED = """
flagged AS (
  SELECT *, "costCurtailRenewable" <= "costCurtailNuclear" AS "curtailRenewableFirst" FROM solved)
"""
_SUMMED = [c for c in AMOUNTS if c != "storageLevel"]
PERCENTS = ("curtailNuclearPercent", "curtailRenewablePercent")
ANNUAL = f"""{DISPATCH}, {FLAGGED},
sums AS (
  SELECT country, share_storage, share_generation, share_renewable, "curtailRenewableFirst",
    {', '.join(f'sum("{c}") AS "{c}"' for c in _SUMMED)}
  FROM flagged GROUP BY ALL),
annual AS (
  SELECT *, coalesce("curtailNuclear" / nullif(nuclear + "curtailNuclear", 0) * 100, 0)
      AS "curtailNuclearPercent",
    coalesce("curtailRenewable" / nullif(renewable + "curtailRenewable", 0) * 100, 0)
      AS "curtailRenewablePercent"
  FROM sums)
"""
COSTS = f"""{ANNUAL},
costs AS (
  SELECT *, (nuclear + "curtailNuclear") * 1.0 + (renewable + "curtailRenewable") * 2.0
    + "energyNotServed" * 10.0 + demand * share_storage * 10.0 AS cost
  FROM annual WHERE abs(share_generation - 1.1) < 1e-9 AND "curtailRenewableFirst")
"""
ORACLE["hourly_results"] = f"""
WITH {DISPATCH}, {FLAGGED}
SELECT country, scenario_id, {DATE}, {rs([*AMOUNTS, *ATTRIBUTES])}, "curtailRenewableFirst"
FROM flagged
WHERE abs(share_generation - 1.1) < 1e-9 AND abs(share_storage - 0.001) < 1e-9
  AND abs(share_renewable - 0.5) < 1e-9 AND "curtailRenewableFirst"
"""
ORACLE["annual_results"] = f"""
WITH {ANNUAL}
SELECT country, {rs(ATTRIBUTES[:3])}, "curtailRenewableFirst",
  {rs([*_SUMMED, *PERCENTS], 4)}
FROM annual
"""
ORACLE["generation_shares"] = f"""
WITH {ANNUAL}
SELECT DISTINCT {r(even('share_generation', 3), 'share_generation')} FROM annual ORDER BY 1
"""
ORACLE["scenario_cost"] = f"""
WITH {COSTS}
SELECT country, {rs(['share_storage', 'share_renewable'])}, {rs([*_SUMMED, *PERCENTS, 'cost'], 4)}
FROM costs
"""


def _cell(share: str, variable: str) -> str:
    return r(
        f'avg("{variable}") FILTER (WHERE abs(share_renewable - {share}) < 1e-9)', f"{float(share) * 100:.10g}", 4
    )


def heatmap(variable: str) -> str:
    return f"""
WITH {COSTS}
SELECT country, {r('share_storage * 100', 'storagePercent', 4)},
  {', '.join(_cell(s, variable) for s in GRID['share_renewable'])}
FROM costs GROUP BY country, share_storage
"""


ORACLE["heatmap_pivot"] = heatmap("cost")
for _variable in VARIABLES[1:]:
    ORACLE[f"heatmap_{_variable}"] = heatmap(_variable)
ORACLE["count_per_storage"] = f"""
WITH {ANNUAL}
SELECT country, {rs(['share_storage'])}, count(share_renewable) AS n FROM annual
WHERE abs(share_generation - 1) < 1e-9 AND NOT "curtailRenewableFirst" GROUP BY country, share_storage
"""
ORACLE["melt_generation"] = f"WITH {DISPATCH}\n" + "\nUNION ALL\n".join(
    f"SELECT country, scenario_id, {DATE}, '{c}' AS technology, {r(f'''nullif("{c}", 0)''', 'value')} FROM solved"
    for c in ("netStorage", "nuclear", "renewable", "energyNotServed")
)

# ---- comparison of models


def with_totals(single: str) -> str:
    return f"""
single AS ({single}),
model_results AS (
  SELECT model, scenario, variable, technology, year, CAST(sum(q) AS DOUBLE) AS value
  FROM single GROUP BY ALL
  UNION ALL
  SELECT model, scenario, variable, 'total', year, CAST(sum(q) AS DOUBLE) FROM single GROUP BY ALL)
"""


MODEL_RESULTS = with_totals("""
  SELECT 'M' || CAST(l_suppkey % 4 AS VARCHAR) AS model, o_orderpriority AS scenario,
    o_orderstatus AS variable, l_returnflag || l_linestatus AS technology,
    CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(l_quantity AS DECIMAL(18,2)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def _list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


STUDY_RESULTS = with_totals(f"""
  SELECT {_list(MODELS)}[1 + l_suppkey % {len(MODELS)}] AS model,
    {_list(SCENARIOS)}[1 + l_orderkey % {len(SCENARIOS)}] AS scenario,
    {_list(v for v, _ in STUDY_CODES)}[1 + l_partkey % {len(STUDY_CODES)}] AS variable,
    {_list(t for _, t in STUDY_CODES)}[1 + l_partkey % {len(STUDY_CODES)}] AS technology,
    '2050' AS year, CAST(l_quantity AS DECIMAL(18,2)) AS q
  FROM lineitem""")


def category_map(reports: dict) -> str:
    rows = []
    for report, (variable, categories, *order) in reports.items():
        listed = [c for c in (order[0] if order else ()) if c in categories]
        places = listed + [c for c in categories if c not in listed]
        for category, codes in categories.items():
            for code in codes:
                rows.append(f"('{report}', '{variable}', {places.index(category)}, '{category}', '{code}')")
    return f"""
map AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(report, variable, position, category, technology)),
parts AS (
  SELECT report, model, scenario, CAST(position AS INTEGER) AS position, category, sum(value) AS value
  FROM model_results JOIN map USING (variable, technology) GROUP BY ALL)
"""


def spreads(extra: str = "") -> str:
    return f"""
SELECT {extra} position, category, count(value) AS n, {r('min(value)', 'lowest')},
  {r('quantile_cont(value, 0.25)', 'lowerQuartile')}, {r('quantile_cont(value, 0.5)', 'median')},
  {r('quantile_cont(value, 0.75)', 'upperQuartile')}, {r('max(value)', 'highest')}
FROM parts GROUP BY {extra} position, category
"""


def _year(year: int, where: str = "true") -> str:
    return (
        f"chosen AS (SELECT * FROM model_results WHERE year = '{year}' AND {where})"
    )


def _fixture_parts(variable: str, source: str = "chosen", order=()) -> str:
    return category_map({"": (variable, FIXTURE_MAP, order)}).replace("model_results", source)


ORACLE["category_rollup"] = f"""
WITH {MODEL_RESULTS}, {_year(1998)}, {_fixture_parts('O')}
SELECT model, scenario, position, category, {rs(['value'])},
  {r('sum(value) OVER (PARTITION BY model, scenario)', 'onTop')}
FROM parts
"""
ORACLE["category_rollup_on_variable"] = f"""
WITH {MODEL_RESULTS}, {_year(1998, "model IN ('M0', 'M2', 'M3')")}, {_fixture_parts('O')},
other AS (
  SELECT model, scenario, sum(value) AS top FROM chosen
  WHERE variable = 'P' AND technology <> 'total' GROUP BY 1, 2)
SELECT model, scenario, position, category, {r('value * 0.001', 'value')}, {r('top * 0.001', 'onTop')}
FROM parts LEFT JOIN other USING (model, scenario)
"""
ORACLE["category_spread"] = f"""
WITH {MODEL_RESULTS}, {_year(1999)}, {_fixture_parts('F', order=('gamma', 'alpha', 'delta'))}
{spreads()}
"""
_SCATTER = f"""
SELECT model, scenario, {r('sum(value)', 'value')},
  {r('avg(sum(value)) OVER (PARTITION BY model)', 'modelMean')}
FROM model_results
"""
ORACLE["model_scatter"] = f"""
WITH {MODEL_RESULTS} {_SCATTER}
WHERE variable = 'P' AND year = '2000' AND technology = 'total' GROUP BY model, scenario
"""
ORACLE["comparison_csv"] = f"""
WITH {MODEL_RESULTS}
SELECT model, scenario, variable, technology, year, {rs(['value'])} FROM model_results
"""
ORACLE["bar_reports"] = f"""
WITH {STUDY_RESULTS}, {category_map(comparison.BARS)}
SELECT report, model, scenario, position, category, {rs(['value'])} FROM parts
"""
ORACLE["spread_reports"] = f"""
WITH {STUDY_RESULTS}, {category_map(comparison.SPREADS)} {spreads('report,')}
"""
ORACLE["scatter_report"] = f"""
WITH {STUDY_RESULTS} {_SCATTER}
WHERE variable = 'electricity_supply' AND technology = 'total' GROUP BY model, scenario
"""

ORACLE["checked_csv"] = f"""
WITH {MODEL_RESULTS}
SELECT model, scenario, variable, technology, year, {rs(['value'])} FROM model_results
WHERE NOT (technology = 'total' AND model = 'M1') AND NOT (model = 'M2' AND year = '1996')
"""
ORACLE["bad_csv_cells"] = f"""
WITH {MODEL_RESULTS}
SELECT 'value' AS "column", count(*) AS n FROM model_results WHERE technology = 'total' AND model = 'M1'
UNION ALL SELECT 'line', count(*) FROM model_results WHERE model = 'M2' AND year = '1996'
"""


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(repr(c) for c in row) + ")" for row in rows)


_NAMED = [(i, m, n, *TYPICAL_DAYS[m]) for i, (m, n) in enumerate(MODELS.items())]
ORACLE["named_results"] = f"""
WITH {STUDY_RESULTS},
models AS (
  SELECT * FROM (VALUES {_rows(_NAMED)})
    AS t("modelPosition", model, name, summer, "summerDay", winter, "winterDay")),
places AS (SELECT * FROM (VALUES {_rows(enumerate(SCENARIOS))}) AS t("scenarioPosition", scenario)),
points AS (
  {_SCATTER} WHERE variable = 'electricity_supply' AND technology = 'total' GROUP BY model, scenario)
SELECT model, scenario, value, "modelMean", CAST("modelPosition" AS INTEGER) AS "modelPosition", name, summer,
  "summerDay", winter, "winterDay", CAST("scenarioPosition" AS INTEGER) AS "scenarioPosition"
FROM points LEFT JOIN models USING (model) LEFT JOIN places USING (scenario)
"""

# Stored tables give what the tables they were written from give.
ORACLE["stored_country_period"] = ORACLE["scan_country_period"]
ORACLE["stored_capacity_stats"] = ORACLE["capacity_stats"]
ORACLE["stored_hourly_results"] = ORACLE["hourly_results"]
ORACLE["stored_annual_results"] = ORACLE["annual_results"]
ORACLE["stored_hour_scan"] = ORACLE["scan_country_period"]
ORACLE["stored_interleaved_results"] = ORACLE["hourly_results"]
ORACLE["stored_circular_lag"] = ORACLE["circular_lag"]
ORACLE["stored_normalize_to_total"] = ORACLE["normalize_to_total"]
ORACLE["stored_sweep_totals"] = ORACLE["sweep_totals"]
ORACLE["stored_union"] = ORACLE["union_scenarios"]

# The studies give, for their place and year, what the single queries give.
_PLACE = f"country = '{STUDY_PLACE['country']}' AND year = {STUDY_PLACE['year']}"
for _table, _same in (
    ("capacity", "capacity_stats"),
    ("overview", "observed_overview"),
    ("implied", "implied_from_stats"),
    ("statistics", "storage_stats_by_year"),
    ("daily", "resample_days_percent"),
    ("profiles", "stacked_profile"),
):
    ORACLE[f"profile_study_{_table}"] = f"SELECT * FROM ({ORACLE[_same]}) WHERE {_PLACE}"
ORACLE["profile_study_hourly"] = f"""
WITH {YEAR_BALANCE}
SELECT country, year, {TIME}, {rs([*SHARED, 'TotalSupply', 'ExcessSupply', 'ExcessDemand'])}
FROM balance WHERE {_PLACE}
"""
ORACLE["result_study_annual"] = ORACLE["annual_results"]
ORACLE["result_study_cost"] = ORACLE["scenario_cost"]
ORACLE["result_study_heatmap"] = ORACLE["heatmap_curtailRenewablePercent"]
