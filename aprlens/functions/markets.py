"""Market names ``<id>-<VENUE>-<SYMBOL>-<DDMONYYYY>`` and funding file names ``<Exchange>-<ASSET>``.

The functions take and return SQL text: a lookup table is one expression to hand over instead of a hundred
calls, which is most of the time it takes to build a plan.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame

# Display names of the known venues.
EXCHANGE_NAMES = {
    "BINANCE": "Binance",
    "HYPERLIQUID": "Hyperliquid",
    "OKX": "OKX",
    "BYBIT": "Bybit",
    "GATE": "Gate",
    "KUCOIN": "KuCoin",
    "LIGHTER": "Lighter",
}

# Symbols whose asset is not the symbol itself.
ASSET_ALIASES = {
    "BTCUSDT": "BTC",
    "ETHUSDT": "ETH",
    "HYPEUSDT": "HYPE",
    "BNBUSDT": "BNB",
    "XRPUSDT": "XRP",
    "SOLUSDT": "SOL",
    "CLUSDT": "CLOIL",
    "BZUSDT": "BRENTOIL",
    "XAUUSDT": "XAU",
    "XAGUSDT": "XAG",
    "CL": "CLOIL",
    "CLOIL": "CLOIL",
    "BRENTOIL": "BRENTOIL",
    "GOLD": "XAU",
    "SILVER": "XAG",
    "SP500": "S&P500",
    "XYZ100": "XYZ100",
}

# Month names of a maturity.
MONTHS = {
    "JAN": "01", "FEB": "02", "MAR": "03", "APR": "04", "MAY": "05", "JUN": "06", "JUL": "07", "AUG": "08",
    "SEP": "09", "OCT": "10", "NOV": "11", "DEC": "12",
}

# The market name pattern, the length of its maturity, the symbol prefix that is not part of the asset.
MARKET_PATTERN = "^[0-9]+-[^-]+-.+-[0-9]{2}[A-Z]{3}[0-9]{4}$"
MATURITY_LENGTH = 9
LETTER = "\\\\p{L}"
SYMBOL_PREFIX = "xyz"
QUOTE_SUFFIX = "USDT"

MARKET_COLUMNS = ["market_id", "venue", "exchange", "symbol", "asset", "maturity"]


def _lookup(entries: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"'{word}'" for word in chain(*entries.items()))
    return f"try_element_at(map({pairs}), {key})"


def title_case(text: str) -> str:
    """Upper-case every letter that does not follow a letter, lower-case the rest."""
    starts_word = f"i = 0 OR NOT get(letters, i - 1) RLIKE '{LETTER}'"
    titled = f"array_join(transform(letters, (c, i) -> IF({starts_word}, upper(c), lower(c))), '')"
    return f"transform(array(split({text}, '')), letters -> {titled})[0]"  # cut into letters once, not for each letter


def exchange_name(venue: str) -> str:
    return f"coalesce({_lookup(EXCHANGE_NAMES, venue)}, {title_case(venue)})"


def asset_of_symbol(symbol: str) -> str:
    plain = f"IF(startswith({symbol}, '{SYMBOL_PREFIX}'), substring({symbol}, {len(SYMBOL_PREFIX) + 1}), {symbol})"
    token = f"upper({plain})"
    stripped = f"IF(endswith({token}, '{QUOTE_SUFFIX}'), left({token}, length({token}) - {len(QUOTE_SUFFIX)}), {token})"
    return f"coalesce({_lookup(ASSET_ALIASES, token)}, {stripped})"


def maturity_date(text: str) -> str:
    """``DDMONYYYY`` to a date, NULL where there is no such day."""
    month = _lookup(MONTHS, f"substring({text}, 3, 3)")
    return f"try_cast(concat(substring({text}, 6, 4), '-', {month}, '-', left({text}, 2)) AS DATE)"


def is_market_name(market: str) -> str:
    return f"{market} RLIKE '{MARKET_PATTERN}'"


def with_market_columns(df: DataFrame) -> DataFrame:
    """Add the six columns a ``market`` name encodes; NULL throughout for a name of another form.

    They depend on the name alone, so aggregating jobs group by ``market`` and call this on the result. The
    pattern is matched once; the first two parts hold no dash, so the rest are cut out by position. The
    generator keeps Spark from moving a later filter on these columns, with the whole of their derivation,
    below the aggregate onto the raw rows. It is handed finished columns: what stands inside it is not compiled.
    """
    kept = [f"`{c}`" for c in df.columns if c not in MARKET_COLUMNS]
    cut = "length(market_id) + length(venue) + 2"
    return (
        df.selectExpr(*kept, f"IF({is_market_name('market')}, market, NULL) AS _name")
        .selectExpr(
            *kept,
            "_name",
            "substring_index(_name, '-', 1) AS market_id",
            "substring_index(substring_index(_name, '-', 2), '-', -1) AS venue",
        )
        .selectExpr(
            *kept,
            "market_id",
            "venue",
            f"substring(_name, {cut} + 1, length(_name) - ({cut}) - {MATURITY_LENGTH + 1}) AS symbol",
            f"right(_name, {MATURITY_LENGTH}) AS _maturity",
        )
        .selectExpr(
            *kept,
            "market_id",
            "venue",
            f"{exchange_name('venue')} AS exchange",
            "symbol",
            f"{asset_of_symbol('symbol')} AS asset",
            f"{maturity_date('_maturity')} AS maturity",
        )
        .selectExpr(*kept, f"explode(array(struct({', '.join(MARKET_COLUMNS)}))) AS _parts")
        .selectExpr(*kept, "_parts.*")
    )


def funding_exchange(stem: str) -> str:
    """Exchange of a funding file, NULL when the name has no dash."""
    return f"IF(contains({stem}, '-'), substring_index({stem}, '-', 1), NULL)"


def funding_asset(stem: str) -> str:
    asset = f"upper(substring({stem}, nullif(instr({stem}, '-'), 0) + 1))"
    return f"coalesce({_lookup(ASSET_ALIASES, asset)}, {asset})"
