"""Prequalification of all taxpayers at once: every block is one frame keyed by taxpayer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from balanza.operators import forecast, network, products, ratios, series, tree


def prequalify(inv: DataFrame, monthly: DataFrame, trees: DataFrame, sold: DataFrame, as_of) -> dict[str, DataFrame]:
    """Frames by block name; each is lazy, so only the blocks that are written are computed.

    ``inv`` invoices, ``monthly`` the long series, ``trees`` (taxpayer, statement, tree), ``sold``
    product rows.
    """
    history = series.raw_history(monthly)
    flat = tree.flatten_tree(trees, ["taxpayer", "statement"])
    inputs = ratios.year_inputs(tree.account_values(flat), series.annual_cash_flow(history))
    nodes = network.concentration(inv, as_of)
    mix = products.product_mix(sold)
    return {
        "history": history,
        "window_stats": series.window_stats(history, as_of),
        "ratios": ratios.ratios(series.valid_years(inputs).drop("recency")),
        "concentration": network.top_counterparties(nodes),
        "trade_network": network.trade_network(inv),
        "products": products.top_products(mix),
        "forecast": forecast.forecast_all(monthly),
    }
