"""Yearly inputs and financial ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.money import safe_ratio

# Account names that give each yearly input, by statement.
ACCOUNTS = {
    "assets": ("balance", ("Activo", "Total Activo")),
    "liabilities": ("balance", ("Pasivo", "Total Pasivo")),
    "equity": ("balance", ("Capital contable", "Total capital", "Capital")),
    "current_assets": ("balance", ("Activo a corto plazo",)),
    "long_assets": ("balance", ("Activo a largo plazo",)),
    "current_liabilities": ("balance", ("Pasivo a corto plazo",)),
    "long_liabilities": ("balance", ("Pasivo a largo plazo",)),
    "social_equity": ("balance", ("Capital Social",)),
    "cash_and_equivalents": ("balance", ("Efectivo y equivalentes de efectivo",)),
    "inventory": ("balance", ("Inventarios",)),
    "accounts_receivable": ("balance", ("Cuentas y documentos por cobrar", "Clientes")),
    "accounts_payable": ("balance", ("Cuentas y documentos por pagar", "Proveedores")),
    "fixed_assets": ("balance", ("Propiedades, plantas y equipo", "Propiedades, planta y equipo")),
    "retained_earnings": ("balance", ("Utilidades acumuladas",)),
    "revenue": ("income", ("Ingresos Netos", "Ventas netas", "Ingresos")),
    "gross_profit": ("income", ("Utilidad Bruta",)),
    "gross_loss": ("income", ("Pérdida Bruta",)),
    "net_profit": ("income", ("Utilidad neta", "Resultado Neto")),
    "net_loss": ("income", ("Pérdida neta", "Pérdida del ejercicio")),
    "ebit_profit": ("income", ("Utilidad de operación", "EBIT")),
    "ebit_loss": ("income", ("Pérdida de operación",)),
    "ebt_profit": ("income", ("Utilidad antes de Impuestos a la utilidad", "Utilidad antes de impuestos", "EBT")),
    "ebt_loss": ("income", ("Pérdida antes de Impuestos a la utilidad", "Pérdida antes de impuestos")),
    "cogs": ("income", ("Costo de ventas",)),
    "interest_expense": ("income", ("Gastos por intereses", "Gastos Financieros")),
}


def year_inputs(values: DataFrame, cash_flow: DataFrame | None = None) -> DataFrame:
    """One wide row per taxpayer and year from (taxpayer, year, account, amount), zeros for gaps.

    Taxes are earnings before tax minus net income.
    """
    wide = values.groupBy("taxpayer", "year").agg(
        *[F.coalesce(F.max(F.when(F.col("account") == a, F.col("amount").cast("double"))), F.lit(0.0)).alias(a) for a in ACCOUNTS]
    )
    out = wide.withColumn(
        "taxes", F.round((F.col("ebt_profit") - F.col("ebt_loss")) - (F.col("net_profit") - F.col("net_loss")), 2)
    )
    if cash_flow is None:
        return out.withColumn("operating_cash_flow", F.lit(0.0))
    flow = cash_flow.select("taxpayer", "year", F.col("operating_cash_flow").cast("double").alias("operating_cash_flow"))
    return out.join(flow, ["taxpayer", "year"], "left").withColumn("operating_cash_flow", F.coalesce("operating_cash_flow", F.lit(0.0)))


def _signed(profit: Column, loss: Column) -> Column:
    """Profit, else the loss as a negative value."""
    return F.when(profit != 0, profit).when(loss > 0, -loss).otherwise(F.lit(0.0))


def ratios(inputs: DataFrame) -> DataFrame:
    """Liquidity, return, solvency, cash, activity and Altman ratios per taxpayer and year."""
    c = F.col
    base = inputs.withColumns({
        "gross_income": _signed(c("gross_profit"), c("gross_loss")),
        "net_income": _signed(c("net_profit"), c("net_loss")),
        "ebit": _signed(c("ebit_profit"), c("ebit_loss")),
        "_ebt": _signed(c("ebt_profit"), c("ebt_loss")),
        "_cogs": F.abs("cogs"),
        "_interest": F.abs("interest_expense"),
        "working_capital": c("current_assets") - c("current_liabilities"),
    }).withColumns({
        "ebt": F.when((c("_ebt") == 0) & (c("net_income") != 0), c("net_income") + c("taxes")).otherwise(c("_ebt")),
        "nopat": c("ebit") - c("taxes"),
    })
    assets, liabilities, revenue = c("assets"), c("liabilities"), c("revenue")
    altman = (
        1.2 * safe_ratio(c("working_capital"), assets) + 1.4 * safe_ratio(c("retained_earnings"), assets)
        + 3.3 * safe_ratio(c("ebit"), assets) + 0.6 * safe_ratio(c("equity"), liabilities) + 1.0 * safe_ratio(revenue, assets)
    )
    out = {
        "roa": (safe_ratio(c("net_income"), assets), 4),
        "roe": (safe_ratio(c("net_income"), c("equity")), 4),
        "net_margin_pct": (safe_ratio(c("net_income"), revenue) * 100, 2),
        "roa_before_tax": (safe_ratio(c("ebt"), assets), 4),
        "current_ratio": (safe_ratio(c("current_assets"), c("current_liabilities")), 2),
        "quick_ratio": (safe_ratio(c("current_assets") - c("inventory"), c("current_liabilities")), 2),
        "cash_ratio": (safe_ratio(c("cash_and_equivalents"), c("current_liabilities")), 2),
        "leverage": (safe_ratio(liabilities, c("equity")), 2),
        "debt_ratio": (safe_ratio(liabilities, assets), 4),
        "interest_coverage": (safe_ratio(c("ebit"), c("_interest")), 2),
        "cash_flow_coverage": (safe_ratio(c("operating_cash_flow"), liabilities), 2),
        "working_capital": (c("working_capital"), 2),
        "dio": (safe_ratio(c("inventory"), c("_cogs")) * 365, 1),
        "dso": (safe_ratio(c("accounts_receivable"), revenue) * 365, 1),
        "dpo": (safe_ratio(c("accounts_payable"), c("_cogs")) * 365, 1),
        "fixed_asset_turnover": (safe_ratio(revenue, c("fixed_assets")), 2),
        "total_asset_turnover": (safe_ratio(revenue, assets), 2),
        "altman_z": (altman, 2),
        "operating_cash_flow": (c("operating_cash_flow"), 2),
        "ebit": (c("ebit"), 2),
        "ebt": (c("ebt"), 2),
        "nopat": (c("nopat"), 2),
        "gross_income": (c("gross_income"), 2),
        "net_income": (c("net_income"), 2),
        "taxes": (c("taxes"), 2),
    }
    return base.select("taxpayer", "year", *[F.round(v, d).alias(n) for n, (v, d) in out.items()])
