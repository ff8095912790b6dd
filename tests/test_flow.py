"""Income flows of statements written by hand: both topologies, missing items, folded ends."""

import pytest

from tarnbeck.operators import flow as W


def graph(spark, tolerance=0.5, **items):
    rows = [("s", k.replace("_", " "), None if v is None else str(v)) for k, v in items.items()]
    graphs = W.flows(W.line_items(spark.createDataFrame(rows, "statement string, name string, value string")), tolerance)
    edges = {(e.source, e.target): (e.value, e.kind) for e in W.flow_edges(graphs).collect()}
    nodes = {n.node: n for n in W.flow_nodes(graphs).collect()}
    return edges, nodes, [r.node for r in W.unbalanced(graphs, tolerance).collect()]


def test_profit_flows_through(spark):
    edges, nodes, odd = graph(spark, Total_Revenue=1000, CostOfRevenue=400, Selling_General_And_Administration=150, ResearchAndDevelopment=50, Interest_Expense=-20, Other_Income_Expense=10, TaxProvision=90, NetIncome=300, EBITDA=7)
    assert edges == {
        ("Revenue", "Cost of Revenue"): (400, "cost"), ("Revenue", "Gross Profit"): (600, "flow"), ("Gross Profit", "SG&A"): (150, "cost"), ("Gross Profit", "R&D"): (50, "cost"),
        ("Gross Profit", "Operating Income"): (400, "flow"), ("Operating Income", "Interest"): (20, "cost"), ("Operating Income", "Pretax Income"): (390, "flow"), ("Other Income", "Pretax Income"): (10, "flow"),
        ("Pretax Income", "Taxes"): (90, "cost"), ("Pretax Income", "Net Income"): (300, "flow")}
    assert {n: r.level for n, r in nodes.items()} == {"Revenue": 0, "Cost of Revenue": 1, "Gross Profit": 1, "SG&A": 2, "R&D": 2, "Operating Income": 2, "Interest": 3, "Pretax Income": 3, "Other Income": 2, "Taxes": 4, "Net Income": 4}
    assert set(odd) == {"Operating Income", "Pretax Income"}  # other income is in the pretax figure and beside it


def test_flows_are_kept_where_the_items_agree(spark):
    edges, nodes, odd = graph(spark, TotalRevenue=1000, Gross_Profit=600, OperatingExpense=200, InterestExpense=20, OtherIncomeExpense=-30, Tax_Provision=50, Net_Income=300)
    assert odd == [] and nodes["Other Expense"].amount == 30 and edges["Gross Profit", "Operating Expenses"] == (200, "cost")
    for n in ("Gross Profit", "Operating Income", "Pretax Income"):
        assert nodes[n].inflow == nodes[n].outflow


@pytest.mark.parametrize(
    "net, expected",
    [
        (-100, {("Operating Loss", "Net Loss"): (100, "cost")}),
        (-60, {("Operating Loss", "Interest/Other Income"): (40, "flow"), ("Operating Loss", "Net Loss"): (60, "cost")}),
        (-130, {("Operating Loss", "Net Loss"): (100, "cost"), ("Interest/Other Charges", "Net Loss"): (30, "cost")}),
        (25, {("Operating Loss", "Interest/Other Income"): (100, "flow"), ("Interest/Other Income", "Net Income"): (25, "flow")}),
        (None, {}),
    ],
)
def test_operating_loss(spark, net, expected):
    edges, nodes, _ = graph(spark, Total_Revenue=500, Cost_Of_Revenue=300, Operating_Expense=300, Operating_Income=-100, Net_Income=net)
    spine = {("Revenue", "Cost of Revenue"): (300, "cost"), ("Revenue", "Gross Profit"): (200, "flow"), ("Gross Profit", "Operating Expenses"): (300, "cost"), ("Gross Profit", "Operating Loss"): (100, "cost")}
    assert edges == spine | expected
    assert nodes["Operating Loss"].amount == 100 and (net != 25 or nodes["Interest/Other Income"].amount == 125)


def test_a_small_difference_of_losses_needs_no_edge(spark):
    edges, _, _ = graph(spark, tolerance=50, Total_Revenue=500, Cost_Of_Revenue=300, Operating_Expense=300, Operating_Income=-100, Net_Income=-130)
    assert edges["Operating Loss", "Net Loss"] == (130, "cost") and ("Interest/Other Charges", "Net Loss") not in edges


def test_pretax_loss_after_an_operating_profit(spark):
    edges, nodes, _ = graph(spark, Total_Revenue=500, Cost_Of_Revenue=300, Operating_Expense=150, Interest_Expense=80, Tax_Provision=5, Net_Income=-35)
    assert edges["Operating Income", "Interest"] == (80, "cost") and ("Operating Income", "Pretax Loss") not in edges  # nothing is left to flow
    assert edges["Pretax Loss", "Taxes"] == (5, "cost") and edges["Pretax Loss", "Net Loss"] == (35, "cost") and nodes["Pretax Loss"].amount == 30


def test_small_ends_fold_from_two_on(spark):
    base = dict(Total_Revenue=100_000, Cost_Of_Revenue=40_000, Selling_General_And_Administration=30_000, Net_Income=29_780)
    edges, _, _ = graph(spark, Research_And_Development=20, **base)
    assert ("Gross Profit", "R&D") in edges
    edges, nodes, _ = graph(spark, Research_And_Development=20, Interest_Expense=100, Tax_Provision=100, **base)
    assert edges["Gross Profit", "Other"] == (20, "cost") and edges["Operating Income", "Other"] == (100, "cost") and edges["Pretax Income", "Other"] == (100, "cost")
    assert nodes["Other"].amount == 220 == nodes["Other"].inflow and nodes["Other"].level == W.NET and not {"R&D", "Interest", "Taxes"} & set(nodes)
    assert list(edges).index(("Gross Profit", "Other")) < list(edges).index(("Gross Profit", "Operating Income"))


def test_odd_values(spark):
    edges, nodes, _ = graph(spark, Total_Revenue="n/a", TotalRevenue="100", Cost_Of_Revenue="NaN", Gross_Profit=None, Net_Income="")
    assert edges == {} and nodes["Revenue"].amount == 100
    assert W.flows(W.line_items(spark.createDataFrame([], "statement string, name string, value string"))).collect() == []
    rows = [("a", "Total Revenue", "10"), ("a", "Total Revenue", "10"), (None, "Total Revenue", "3"), ("b", "Headcount", "3")]
    got = W.line_items(spark.createDataFrame(rows, "statement string, name string, value string")).collect()
    assert sorted(((r.statement, r.revenue) for r in got), key=repr) == [("a", 10.0), (None, 3.0)]


def test_margins(spark):
    rows = [("a", "Total Revenue", "200"), ("a", "Cost Of Revenue", "50"), ("a", "Operating Income", "-20"), ("b", "Gross Profit", "5")]
    got = {r.statement: tuple(r)[1:] for r in W.margins(W.line_items(spark.createDataFrame(rows, "statement string, name string, value string"))).collect()}
    assert got == {"a": (75.0, -10.0, 0.0), "b": (None, None, None)}
