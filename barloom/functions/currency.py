"""Quote currency of a symbol from its exchange suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Exchange suffix -> quote currency.
CURRENCY = {
    "L": "GBp", "PA": "EUR", "DE": "EUR", "AS": "EUR", "BR": "EUR", "MI": "EUR", "MC": "EUR", "LS": "EUR",
    "VI": "EUR", "HE": "EUR", "IR": "EUR", "F": "EUR", "SW": "CHF", "ST": "SEK", "CO": "DKK", "OL": "NOK",
    "T": "JPY", "HK": "HKD", "KS": "KRW", "KQ": "KRW", "TW": "TWD", "TWO": "TWD", "NS": "INR", "BO": "INR",
    "SI": "SGD", "SS": "CNY", "SZ": "CNY", "AX": "AUD", "NZ": "NZD", "TO": "CAD", "V": "CAD", "SA": "BRL",
    "MX": "MXN",
}
# Currency -> display mark.
MARK = {
    "USD": "$", "EUR": "€", "GBp": "p", "JPY": "¥", "HKD": "HK$", "KRW": "₩", "CHF": "CHF ", "AUD": "A$",
    "CAD": "C$", "BRL": "R$", "INR": "₹", "TWD": "NT$", "SGD": "S$", "SEK": "kr", "DKK": "kr", "NOK": "kr",
    "CNY": "¥", "MXN": "Mex$", "NZD": "NZ$",
}


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def currency_of(ticker: Column) -> Column:
    suffix = F.upper(F.substring_index(ticker, ".", -1))
    return F.when(ticker.contains("."), _lookup(CURRENCY, suffix, "USD")).otherwise("USD")


def mark_of(currency: Column) -> Column:
    return _lookup(MARK, currency, "")


def usd_rates(fx: DataFrame) -> DataFrame:
    """Last known rate of each currency (currency, rate); pence are a hundredth of the pound's rate."""
    last = fx.filter(F.col("rate").isNotNull()).groupBy("currency").agg(F.max_by("rate", "date").alias("rate"))
    pence = last.filter("currency = 'GBP'").select(F.lit("GBp").alias("currency"), (F.col("rate") / 100).alias("rate"))
    return last.filter("currency <> 'GBp'").unionByName(pence)


def attach_usd_rate(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """`usd_rate` per row; 1.0 where the currency has no rate. Rates have one row per currency of the
    fixed table above, so broadcasting them is bounded."""
    known = rates.filter(F.col("currency").isin(sorted({*CURRENCY.values(), "GBP"}))).withColumnRenamed("rate", "_rate")
    d = panel.withColumn("currency", currency_of(F.col("ticker"))).join(F.broadcast(known), "currency", "left")
    return d.withColumn("usd_rate", F.when(F.col("currency") == "USD", 1.0).otherwise(F.coalesce("_rate", F.lit(1.0)))).drop("_rate")
