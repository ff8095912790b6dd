"""Income flows: the graph of what a period's revenue becomes, for profits and for losses.

A statement arrives as rows (statement, name, value as text) under the names that providers use. Its items become one
row, its nodes and edges two short arrays in that row (at most 17 and 14), so that a graph costs no shuffle beyond the
one that gathers the items. Edges carry positive values alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names under which providers list each item, the preferred ones first.
NAMES = {
    "revenue": ["Total Revenue", "TotalRevenue"],
    "cost": ["Cost Of Revenue", "CostOfRevenue"],
    "gross": ["Gross Profit", "GrossProfit"],
    "opex": ["Operating Expense", "OperatingExpense"],
    "selling": ["Selling General And Administration", "SellingGeneralAndAdministration"],
    "research": ["Research And Development", "ResearchAndDevelopment", "Research Development"],
    "other_opex": ["Other Operating Expenses", "OtherOperatingExpenses"],
    "operating": ["Operating Income", "OperatingIncome", "EBIT"],
    "interest": ["Interest Expense", "InterestExpense", "Interest Expense Non Operating", "InterestExpenseNonOperating"],
    "tax": ["Tax Provision", "TaxProvision", "Income Tax Expense", "IncomeTaxExpense"],
    "other_income": ["Other Income Expense", "OtherIncomeExpense", "Other Non Operating Income Expenses"],
    "net": ["Net Income", "NetIncome", "Net Income Common Stockholders", "NetIncomeCommonStockholders"],
    "pretax": ["Pretax Income", "PretaxIncome"],
}
#: Charges whose sign providers disagree on.
UNSIGNED = ("interest", "tax")
#: Fixed value: difference of operating and net loss up to which no edge explains it.
TOLERANCE = 1e6
#: Fixed value: share of the revenue below which a terminal cost is small.
SMALL = 0.0025
#: Digits of amounts behind the point.
DIGITS = 4
REVENUE, GROSS, OPERATING, PRETAX, NET = range(5)


def line_items(raw: DataFrame) -> DataFrame:
    """One row of items per statement: of each the first listed name with a number other than zero, or 0.

    Text that is no number, and NaN, counts as missing. Gross profit and cost follow from each other, operating expense
    from its parts, operating income from gross profit, where they are missing.
    """
    value = F.col("value").try_cast("double")
    known = raw.where(F.col("name").isin([n for names in NAMES.values() for n in names]))
    seen = {n: F.max(F.when((F.col("name") == n) & ~F.isnan(value), value)) for names in NAMES.values() for n in names}
    first = {item: F.coalesce(*[F.nullif(seen[n], F.lit(0.0)) for n in names], F.lit(0.0)) for item, names in NAMES.items()}
    items = known.groupBy("statement").agg(*[(F.abs(c) if i in UNSIGNED else c).alias(i) for i, c in first.items()])
    c = F.col
    filled = lambda name, when, value: items_.withColumn(name, F.when((c(name) == 0) & when, value).otherwise(c(name)))
    items_ = items
    items_ = filled("gross", (c("revenue") > 0) & (c("cost") > 0), c("revenue") - c("cost"))
    items_ = filled("cost", (c("revenue") > 0) & (c("gross") > 0), c("revenue") - c("gross"))
    items_ = filled("opex", (c("selling") > 0) | (c("research") > 0), c("selling") + c("research") + c("other_opex"))
    return filled("operating", c("gross") > 0, c("gross") - c("opex"))


def _graph(tolerance: float) -> tuple[list[tuple], list[tuple]]:
    """Nodes (name, amount, level, kind, whether it is there) and edges (source, target, value, kind, likewise), in order."""
    c = F.col
    profit, loss = c("operating") > 0, c("operating") < 0
    parts = (c("selling") > 0) | (c("research") > 0) | (c("other_opex") > 0)
    reckoned = c("operating") - c("interest") + c("other_income")
    pretax = F.when(c("pretax") == 0, reckoned).otherwise(c("pretax"))
    up, down = profit & (pretax > 0), profit & (pretax < 0)
    taxed = pretax - c("tax")
    charged = c("operating") - c("interest") + F.least(c("other_income"), F.lit(0.0))
    lost, short = F.abs(c("operating")), F.abs(c("net"))
    eased, worse = loss & (c("net") < 0) & (lost > short + tolerance), loss & (c("net") < 0) & (short > lost + tolerance)
    turned = loss & (c("net") > 0)
    always = F.lit(True)
    nodes = [
        ("Revenue", c("revenue"), REVENUE, "source", always), ("Cost of Revenue", c("cost"), GROSS, "cost", always), ("Gross Profit", c("gross"), GROSS, "flow", always),
        ("SG&A", c("selling"), OPERATING, "cost", c("selling") > 0), ("R&D", c("research"), OPERATING, "cost", c("research") > 0), ("Other OpEx", c("other_opex"), OPERATING, "cost", c("other_opex") > 0),
        ("Operating Expenses", c("opex"), OPERATING, "cost", ~parts & (c("opex") > 0)),
        ("Operating Income", c("operating"), OPERATING, "flow", profit), ("Interest", c("interest"), PRETAX, "cost", profit & (c("interest") > 0)), ("Other Expense", -c("other_income"), PRETAX, "cost", profit & (c("other_income") < 0)),
        ("Pretax Income", pretax, PRETAX, "flow", up), ("Other Income", c("other_income"), OPERATING, "flow", up & (c("other_income") > 0)),
        ("Pretax Loss", F.abs(pretax), PRETAX, "cost", down),
        ("Taxes", c("tax"), NET, "cost", (up | down & (c("net") < 0)) & (c("tax") > 0)),
        ("Operating Loss", lost, OPERATING, "cost", loss),
        ("Net Income", F.when(c("net") == 0, taxed).otherwise(c("net")), NET, "flow", up & ((c("net") > 0) | (c("net") == 0) & (taxed > 0)) | turned),
        ("Net Loss", short, NET, "cost", (up | down | loss) & (c("net") < 0)),
        ("Interest/Other Income", F.when(turned, lost + c("net")).otherwise(lost - short), PRETAX, "flow", eased | turned),
        ("Interest/Other Charges", short - lost, PRETAX, "cost", worse),
    ]
    edges = [
        ("Revenue", "Cost of Revenue", c("cost"), "cost", always), ("Revenue", "Gross Profit", c("gross"), "flow", always),
        ("Gross Profit", "SG&A", c("selling"), "cost", always), ("Gross Profit", "R&D", c("research"), "cost", always), ("Gross Profit", "Other OpEx", c("other_opex"), "cost", always),
        ("Gross Profit", "Operating Expenses", c("opex"), "cost", ~parts),
        ("Gross Profit", "Operating Income", c("operating"), "flow", profit), ("Operating Income", "Interest", c("interest"), "cost", profit), ("Operating Income", "Other Expense", -c("other_income"), "cost", profit),
        ("Operating Income", "Pretax Income", pretax, "flow", up), ("Other Income", "Pretax Income", c("other_income"), "flow", up),
        ("Operating Income", "Pretax Loss", charged, "cost", down),
        ("Pretax Income", "Taxes", c("tax"), "cost", up), ("Pretax Loss", "Taxes", c("tax"), "cost", down & (c("net") < 0)),
        ("Pretax Income", "Net Income", F.when(c("net") == 0, taxed).otherwise(c("net")), "flow", up & (c("net") >= 0)), ("Pretax Income", "Net Loss", taxed, "cost", up & (c("net") < 0)), ("Pretax Loss", "Net Loss", short, "cost", down & (c("net") < 0)),
        ("Gross Profit", "Operating Loss", lost, "cost", loss),
        ("Operating Loss", "Interest/Other Income", F.when(turned, lost).otherwise(lost - short), "flow", eased | turned),
        ("Operating Loss", "Net Loss", F.when(worse, lost).otherwise(short), "cost", loss & (c("net") < 0)),
        ("Interest/Other Charges", "Net Loss", short - lost, "cost", worse), ("Interest/Other Income", "Net Income", c("net"), "flow", turned),
    ]
    return nodes, edges


def _once(df: DataFrame) -> DataFrame:
    """df with its columns reckoned once: a generator keeps their expressions from being put into the functions that use them."""
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("r")).select("r.*")


def _total(edges: Column, when) -> Column:
    return F.aggregate(F.filter(edges, when), F.lit(0.0), lambda s, e: s + e["value"])


def flows(items: DataFrame, tolerance: float = TOLERANCE, share: float = SMALL) -> DataFrame:
    """statement, revenue, nodes (place, node, amount, level, kind), edges (place, source, target, value, kind).

    Two or more costs that lead nowhere and are below `share` of the revenue become one node `Other`, in the last of their
    levels, with one edge from each node that fed them; the spine is never touched. A single small cost keeps its name.
    """
    names, links = _graph(tolerance)
    there = lambda rows: F.filter(F.array(*rows), lambda r: r["there"])
    node = [F.struct(F.lit(k).alias("place"), F.lit(n).alias("node"), F.round(a, DIGITS).alias("amount"), F.lit(at).alias("level"), F.lit(kind).alias("kind"), on.alias("there")) for k, (n, a, at, kind, on) in enumerate(names)]
    edge = [F.struct(F.lit(k).alias("place"), F.lit(a).alias("source"), F.lit(b).alias("target"), v.alias("value"), F.lit(kind).alias("kind"), (on & (v > 0)).alias("there")) for k, (a, b, v, kind, on) in enumerate(links)]
    made = _once(_once(items).select("statement", "revenue", there(node).alias("nodes"), there(edge).alias("edges")))
    into = lambda n: _total(F.col("edges"), lambda e: e["target"] == n)
    ends = lambda n: ~F.exists("edges", lambda e: e["source"] == n)
    small = F.filter("nodes", lambda n: (n["kind"] == "cost") & ends(n["node"]) & (into(n["node"]) > 0) & (into(n["node"]) < F.col("revenue") * share))
    marked = _once(made.withColumn("ends", small)).withColumn("small", F.transform("ends", lambda n: n["node"])).withColumn("level", F.array_max(F.transform("ends", lambda n: n["level"])))
    marked = _once(marked.withColumn("gone", F.filter("edges", lambda e: F.array_contains("small", e["target"]))))
    gone = F.col("gone")
    sources = F.array_distinct(F.transform(gone, lambda e: e["source"]))
    last = len(names)
    joined = F.transform(sources, lambda s: F.struct(
        F.array_min(F.transform(F.filter(gone, lambda e: e["source"] == s), lambda e: e["place"])).alias("place"), s.alias("source"), F.lit("Other").alias("target"),
        _total(gone, lambda e: e["source"] == s).alias("value"), F.lit("cost").alias("kind"), F.lit(True).alias("there")))
    edges = F.array_sort(F.concat(F.filter("edges", lambda e: ~F.array_contains("small", e["target"])), joined))
    other = F.struct(F.lit(last).alias("place"), F.lit("Other").alias("node"), F.round(_total(gone, lambda e: F.lit(True)), DIGITS).alias("amount"), F.col("level"), F.lit("cost").alias("kind"), F.lit(True).alias("there"))
    nodes = F.concat(F.filter("nodes", lambda n: ~F.array_contains("small", n["node"])), F.array(other))
    fold = F.size("small") >= 2
    return _once(marked.select("statement", "revenue", F.when(fold, nodes).otherwise(F.col("nodes")).alias("nodes"), F.when(fold, edges).otherwise(F.col("edges")).alias("edges")))


def flow_edges(graphs: DataFrame) -> DataFrame:
    """statement, place (from 0), source, target, value, kind."""
    out = graphs.select("statement", F.posexplode("edges").alias("place", "e"))
    return out.select("statement", "place", "e.source", "e.target", F.round("e.value", DIGITS).alias("value"), "e.kind")


def flow_nodes(graphs: DataFrame) -> DataFrame:
    """statement, place (from 0), node, amount, level, kind, inflow, outflow."""
    flow = lambda end: lambda n: F.round(_total(F.col("edges"), lambda e: e[end] == n["node"]), DIGITS)
    kept = F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), n["amount"].alias("amount"), n["level"].alias("level"), n["kind"].alias("kind"), flow("target")(n).alias("inflow"), flow("source")(n).alias("outflow")))
    return graphs.select("statement", F.posexplode(kept).alias("place", "n")).select("statement", "place", "n.*")


def unbalanced(graphs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """statement, node, difference: nodes with flow on both sides whose in- and outflow differ by more than the tolerance."""
    both = flow_nodes(graphs).where("inflow > 0 AND outflow > 0")
    return both.select("statement", "node", F.round(F.col("inflow") - F.col("outflow"), DIGITS).alias("difference")).where(F.abs("difference") > tolerance)


def margins(items: DataFrame) -> DataFrame:
    """statement, gross, operating and net margin in percent of a positive revenue."""
    of = lambda c: F.when(F.col("revenue") > 0, F.round(F.col(c) / F.col("revenue") * 100, 1))
    return reduce(lambda df, c: df.withColumn(f"{c}_margin", of(c)), ("gross", "operating", "net"), items).select("statement", "gross_margin", "operating_margin", "net_margin")
