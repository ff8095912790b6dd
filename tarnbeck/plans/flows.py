"""Income flows of customers' years: what they were billed, what was returned, taxed and discounted, as statements."""

from __future__ import annotations


from pyspark.sql import functions as F

from tarnbeck.operators import flow as W
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

TOLERANCE = 1000.0
_NET = "cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(4,2)))"
_RATE = "cast(l_extendedprice AS DECIMAL(18,2)) * cast({} AS DECIMAL(4,2))"
_sum = lambda value, when="true": f"cast(sum(CASE WHEN {when} THEN {value} ELSE 0 END) AS DECIMAL(18,4))"
#: A statement per customer and year; segments spell and omit items in their own ways.
_YEARS = f"""SELECT concat(cast(o_custkey AS varchar(20)), '-', cast(year(o_orderdate) AS varchar(4))) AS statement, min(c_mktsegment) AS segment, cast(min(c_acctbal) AS DECIMAL(18,2)) AS balance,
  {_sum(_NET)} AS revenue, {_sum(_NET, "l_returnflag = 'A'")} AS cost, {_sum(_NET, "l_returnflag = 'R'")} AS selling, {_sum(_NET, "l_returnflag = 'N'")} AS rest,
  {_sum(_RATE.format('l_tax'))} AS research, {_sum(_RATE.format('l_discount'), "l_linestatus = 'F'")} AS interest, {_sum(_RATE.format('l_tax'), "l_returnflag = 'N'")} AS tax
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey GROUP BY o_custkey, year(o_orderdate)"""
_SPACED = "segment IN ('AUTOMOBILE', 'BUILDING')"
_ITEMS = [
    (f"CASE WHEN {_SPACED} THEN 'Total Revenue' ELSE 'TotalRevenue' END", "revenue", "true"),
    (f"CASE WHEN {_SPACED} THEN 'Cost Of Revenue' ELSE 'CostOfRevenue' END", "cost", "segment <> 'FURNITURE'"),
    ("'GrossProfit'", "revenue - cost", "segment = 'FURNITURE'"),
    ("'Selling General And Administration'", "selling", "segment <> 'MACHINERY'"),
    (f"CASE WHEN {_SPACED} THEN 'Research And Development' ELSE 'Research Development' END", "research", "segment <> 'MACHINERY'"),
    ("'Operating Expense'", "selling + research", "segment = 'MACHINERY'"),
    ("'EBIT'", "rest - research", "segment = 'HOUSEHOLD'"),
    ("'Interest Expense'", "-interest", "true"),
    ("'Income Tax Expense'", "tax", "true"),
    ("'Other Income Expense'", "balance", "true"),
    ("'Net Income'", "rest - research - interest - tax + balance", "segment IN ('AUTOMOBILE', 'HOUSEHOLD')"),
    ("'NetIncomeCommonStockholders'", "rest - research", "segment = 'FURNITURE'"),
    ("'PretaxIncome'", "rest - research - interest + balance", "segment = 'MACHINERY'"),
    ("'Number Of Employees'", "revenue", "true"),
]
_RAW = f"WITH y AS ({_YEARS}) " + " UNION ALL ".join(f"SELECT statement, {n} AS name, cast(cast({v} AS DECIMAL(20,4)) AS varchar(40)) AS value FROM y WHERE {w}" for n, v, w in _ITEMS)


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(max(v) FILTER (name = '{n}'), 0)" for n in names) + ", 0)"


_ITEM_SQL = f"""raw AS ({plain(_RAW)}),
first AS (SELECT statement, {_first('Total Revenue', 'TotalRevenue')} AS revenue, {_first('Cost Of Revenue', 'CostOfRevenue')} AS cost0, {_first('GrossProfit')} AS gross0, {_first('Operating Expense')} AS opex0,
  {_first('Selling General And Administration')} AS selling, {_first('Research And Development', 'Research Development')} AS research, {_first('EBIT')} AS operating0, abs({_first('Interest Expense')}) AS interest,
  abs({_first('Income Tax Expense')}) AS tax, {_first('Other Income Expense')} AS other_income, {_first('Net Income', 'NetIncomeCommonStockholders')} AS net, {_first('PretaxIncome')} AS pretax0
  FROM (SELECT *, try_cast(value AS DOUBLE) AS v FROM raw) GROUP BY statement),
g AS (SELECT *, CASE WHEN gross0 = 0 AND revenue > 0 AND cost0 > 0 THEN revenue - cost0 ELSE gross0 END AS gross FROM first),
h AS (SELECT *, CASE WHEN cost0 = 0 AND revenue > 0 AND gross > 0 THEN revenue - gross ELSE cost0 END AS cost, CASE WHEN opex0 = 0 AND (selling > 0 OR research > 0) THEN selling + research + 0 ELSE opex0 END AS opex FROM g),
i AS (SELECT *, CASE WHEN operating0 = 0 AND gross > 0 THEN gross - opex ELSE operating0 END AS operating FROM h),
items AS (SELECT *, CASE WHEN pretax0 = 0 THEN operating - interest + other_income ELSE pretax0 END AS pretax FROM i)"""
_LINKS = [
    ("Revenue", "Cost of Revenue", "cost", "cost", "true"), ("Revenue", "Gross Profit", "gross", "flow", "true"), ("Gross Profit", "SG&A", "selling", "cost", "true"), ("Gross Profit", "R&D", "research", "cost", "true"),
    ("Gross Profit", "Operating Expenses", "opex", "cost", "selling <= 0 AND research <= 0"), ("Gross Profit", "Operating Income", "operating", "flow", "operating > 0"),
    ("Operating Income", "Interest", "interest", "cost", "operating > 0"), ("Operating Income", "Other Expense", "-other_income", "cost", "operating > 0"), ("Operating Income", "Pretax Income", "pretax", "flow", "operating > 0"),
    ("Other Income", "Pretax Income", "other_income", "flow", "operating > 0 AND pretax > 0"), ("Operating Income", "Pretax Loss", "operating - interest + least(other_income, 0)", "cost", "operating > 0 AND pretax < 0"),
    ("Pretax Income", "Taxes", "tax", "cost", "operating > 0 AND pretax > 0"), ("Pretax Loss", "Taxes", "tax", "cost", "operating > 0 AND pretax < 0 AND net < 0"),
    ("Pretax Income", "Net Income", "CASE WHEN net = 0 THEN pretax - tax ELSE net END", "flow", "operating > 0 AND pretax > 0 AND net >= 0"), ("Pretax Income", "Net Loss", "pretax - tax", "cost", "operating > 0 AND pretax > 0 AND net < 0"),
    ("Pretax Loss", "Net Loss", "-net", "cost", "operating > 0 AND pretax < 0"), ("Gross Profit", "Operating Loss", "-operating", "cost", "operating < 0"),
    ("Operating Loss", "Interest/Other Income", "CASE WHEN net > 0 THEN -operating WHEN net < 0 AND net - operating > 1000 THEN net - operating ELSE 0 END", "flow", "operating < 0"),
    ("Operating Loss", "Net Loss", "CASE WHEN operating - net > 1000 THEN -operating ELSE -net END", "cost", "operating < 0 AND net < 0"),
    ("Interest/Other Charges", "Net Loss", "operating - net", "cost", "operating < 0 AND net < 0 AND operating - net > 1000"), ("Interest/Other Income", "Net Income", "net", "flow", "operating < 0"),
]
_EDGE_SQL = f"""{_ITEM_SQL},
links AS ({' UNION ALL '.join(f"SELECT statement, revenue, {k} AS k, '{a}' AS source, '{b}' AS target, cast({v} AS DOUBLE) AS value, '{kind}' AS kind FROM items WHERE ({w}) AND ({v}) > 0" for k, (a, b, v, kind, w) in enumerate(_LINKS))}),
ends AS (SELECT statement, target, sum(value) AS v FROM links l WHERE kind = 'cost' AND (statement, target) NOT IN (SELECT (statement, source) FROM links) GROUP BY statement, target HAVING sum(value) < max(revenue) * 0.0025),
small AS (SELECT * FROM ends QUALIFY count(*) OVER (PARTITION BY statement) >= 2),
folded AS (SELECT l.statement, min(k) AS k, source, CASE WHEN s.target IS NULL THEN l.target ELSE 'Other' END AS end_, sum(value) AS value, min(kind) AS kind FROM links l LEFT JOIN small s ON s.statement = l.statement AND s.target = l.target GROUP BY l.statement, source, end_)"""


def _raw(t: Tables):
    """The same rows as _RAW, from one reading of the years."""
    each = [F.struct(F.expr(n).alias("name"), F.expr(f"cast(cast({v} AS DECIMAL(20,4)) AS string)").alias("value"), F.expr(w).alias("there")) for n, v, w in _ITEMS]
    return rows(t, _YEARS).select("statement", F.explode(F.filter(F.array(*each), lambda r: r["there"])).alias("r")).select("statement", "r.name", "r.value")


def _graphs(t: Tables):
    return W.flows(W.line_items(_raw(t)), TOLERANCE)


@query("N01_flow_items", f"WITH {_ITEM_SQL} SELECT statement, revenue, cost, gross, opex, selling, research, 0.0::DOUBLE AS other_opex, operating, interest, tax, other_income, net, pretax0 AS pretax FROM items")
def flow_items(t: Tables):
    return W.line_items(_raw(t))


@query("N01_flow_edges", f"WITH {_EDGE_SQL} SELECT statement, cast(row_number() OVER (PARTITION BY statement ORDER BY k) - 1 AS INTEGER) AS place, source, end_ AS target, round(value, 4) AS value, kind FROM folded")
def flow_edges(t: Tables):
    return W.flow_edges(_graphs(t))


_ENDS = "flow_ends AS (SELECT statement, node, round(sum(i), 4) AS inflow, round(sum(o), 4) AS outflow FROM (SELECT statement, source AS node, 0 AS i, value AS o FROM folded UNION ALL SELECT statement, end_, value, 0 FROM folded) GROUP BY ALL)"
_LEVELS = "CASE WHEN node = 'Revenue' THEN 0 WHEN node IN ('Cost of Revenue', 'Gross Profit') THEN 1 WHEN node IN ('SG&A', 'R&D', 'Operating Expenses', 'Operating Income', 'Operating Loss', 'Other Income') THEN 2 WHEN node IN ('Taxes', 'Net Income', 'Net Loss') THEN 4 ELSE 3 END"


@query("L11_income_flow", f"""WITH {_EDGE_SQL}, {_ENDS}
    SELECT statement, node, inflow, outflow, CASE node WHEN 'Other' THEN (SELECT max({_LEVELS.replace('node', 's.target')}) FROM small s WHERE s.statement = e.statement) ELSE {_LEVELS} END AS level FROM flow_ends e WHERE inflow > 0 OR outflow > 0""")
def income_flow(t: Tables):
    return W.flow_nodes(_graphs(t)).where("inflow > 0 OR outflow > 0").select("statement", "node", "inflow", "outflow", "level")


@query("N01_unbalanced", f"WITH {_EDGE_SQL}, {_ENDS} SELECT statement, node, round(inflow - outflow, 4) AS difference FROM flow_ends WHERE inflow > 0 AND outflow > 0 AND abs(round(inflow - outflow, 4)) > 1000")
def unbalanced(t: Tables):
    return W.unbalanced(_graphs(t), TOLERANCE)


@query("L12_statement_margins", f"WITH {_ITEM_SQL} SELECT statement, " + ", ".join(f"CASE WHEN revenue > 0 THEN round({c} / revenue * 100, 1) END AS {c}_margin" for c in ("gross", "operating", "net")) + " FROM items")
def statement_margins(t: Tables):
    return W.margins(W.line_items(_raw(t)))
