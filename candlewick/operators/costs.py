"""Overnight interest and currency conversion as columns over a broker's specification.

``broker`` is a dict: point, tick_size, tick_value, contract_size, account, profit, base and margin currency, swap_mode,
swap_long, swap_short. It is a setting, so it enters plans as constants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The swap modes, by what their rate is counted in.
SWAP_MODES = ("disabled", "points", "deposit_currency", "profit_currency", "symbol_currency", "margin_currency", "interest_current", "interest_open")


def quote_to_account(broker: dict) -> float:
    """Account units that one unit of the profit currency is worth, by the profile's tick value."""
    return broker["tick_value"] / (broker["tick_size"] * broker["contract_size"])


def profit_to_account(price: Column, broker: dict) -> Column:
    """The same at a price: 1 in the account's currency, 1 / price where the account holds the base, else by the tick value."""
    if broker["profit"] == broker["account"]:
        return F.lit(1.0)
    snapshot = F.lit(quote_to_account(broker))
    return F.when(price > 0, 1 / price).otherwise(snapshot) if broker["base"] == broker["account"] else snapshot


def currency_to_account(currency: str, price: Column, broker: dict) -> Column:
    """Account units of one unit of a currency of the pair; a currency outside of it is an error."""
    if currency == broker["account"]:
        return F.lit(1.0)
    if currency == broker["profit"]:
        return F.lit(quote_to_account(broker))
    if currency == broker["base"]:
        return price * quote_to_account(broker)
    raise ValueError(f"{currency} is neither the account's nor one of the pair's currencies")


def swap_cash(side: Column, volume: Column, entry: Column, price: Column, days: Column, broker: dict) -> Column:
    """Money of ``days`` weighted nights (see joins.rollovers) of a position: 0 if the broker has no swaps."""
    mode = broker["swap_mode"]
    if mode not in SWAP_MODES:
        raise ValueError(f"swap mode {mode} is not supported")
    if mode == "disabled":
        return F.lit(0.0)
    rate = F.when(side == "long", broker["swap_long"]).otherwise(broker["swap_short"])
    interest = rate / 100 / 360 * broker["contract_size"] * quote_to_account(broker)
    a_lot = {
        "points": lambda: rate * (broker["point"] / broker["tick_size"] * broker["tick_value"]),
        "deposit_currency": lambda: rate,
        "profit_currency": lambda: rate * currency_to_account(broker["profit"], price, broker),
        "symbol_currency": lambda: rate * currency_to_account(broker["base"], price, broker),
        "margin_currency": lambda: rate * currency_to_account(broker["margin"], price, broker),
        "interest_current": lambda: interest * price,
        "interest_open": lambda: interest * entry,
    }[mode]()
    return F.when(days > 0, a_lot * volume * days).otherwise(0.0)


def gross_profit(side: Column, entry: Column, exit_price: Column, volume: Column, broker: dict) -> Column:
    """Profit of a closed position in the account's currency, converted at the exit price."""
    direction = F.when(side == "long", 1.0).otherwise(-1.0)
    return (exit_price - entry) * direction * broker["contract_size"] * profit_to_account(exit_price, broker) * volume
