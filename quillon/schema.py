"""Table contracts: declared types, defaults for absent columns, and header synonyms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalars import parse_date, parse_percent, parse_number

PANEL = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("id", T.StringType()),
        T.StructField("ret", T.DoubleType()),
        T.StructField("index_weight", T.DoubleType()),
        T.StructField("index_return", T.DoubleType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("sector_id", T.IntegerType()),
        T.StructField("active", T.IntegerType()),
        T.StructField("ttm", T.DoubleType()),
    ]
)
PANEL_REQUIRED = ("date", "id", "ret", "index_weight")
PANEL_DEFAULTS = {"index_return": None, "spread": 0.0, "duration": 0.0, "sector_id": -1, "active": 1, "ttm": 0.0}
SCORES_REQUIRED = ("date", "id", "h", "y", "l", "u")

#: Other names of panel and log columns, used only where the proper one is absent.
SYNONYMS = {"debenture_id": "id", "time_to_maturity": "ttm", "return": "ret", "horizon": "h"}

# Headers of raw quote sheets, by the column that they fill, and how they are read.
RAW_HEADERS = {
    "date": (("Data",), "date"),
    "debenture_id": (("Debênture", "Debenture", "Ticker"), "text"),
    "duration": (("Duration", "Duração"), "number"),
    "index_weight": (("Peso no índice (%)", "Peso no índice"), "percent"),
    "weighted_mtm": (("MTM ponderado (%)",), "percent"),
    "weighted_return": (("Variação ponderada (%)",), "percent"),
    "weighted_carry": (("Carrego ponderado (%)",), "percent"),
    "spread": (("Spread de compra (%)", "MID spread (Bps/NTNB)"), "percent"),
    "index_value": (("Índice (nível)", "Indice (nível)"), "number"),
    "index_level": (("Índice", "Indice"), "number"),
    "sector": (("Setor", "Segmento"), "text"),
    "issuer": (("Emissor",), "text"),
    "rating": (("Rating",), "text"),
    "return": (("return",), "number"),
}


def rename_synonyms(df: DataFrame, synonyms: Mapping[str, str] = SYNONYMS) -> DataFrame:
    """Rename columns to their proper names where those are absent."""
    for old, new in synonyms.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    """Raise ValueError naming the required columns that are absent."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def null_if_nan(column: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(column), column)


def enforce_schema(df: DataFrame, schema: T.StructType = PANEL, required: tuple[str, ...] = PANEL_REQUIRED, defaults: Mapping = PANEL_DEFAULTS) -> DataFrame:
    """Exactly the columns of `schema`, cast, with defaults for absent optional ones and NaN as null."""
    df = rename_synonyms(df)
    require(df, required)
    out = []
    for f in schema.fields:
        column = F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
        column = column.cast(f.dataType)
        out.append((null_if_nan(column) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else column).alias(f.name))
    return df.select(*out)


def normalize_quotes(df: DataFrame, source: str | None = None) -> DataFrame:
    """Raw quotes under canonical names and types; several headers of one column fill in for each other.

    Rows without a date or an identifier are dropped, before ids become text.
    """
    readers = {"date": parse_date, "number": parse_number, "percent": parse_percent, "text": lambda c: c.cast("string")}
    found = {}
    for name, (headers, kind) in RAW_HEADERS.items():
        present = [readers[kind](F.col(f"`{h}`")) for h in headers if h in df.columns]
        if present:
            found[name] = F.coalesce(*present)
    for name in ("date", "debenture_id"):
        if name not in found:
            raise ValueError(f"no column for {name}")
    out = df.select(*[c.alias(n) for n, c in found.items()], *([F.lit(source).alias("universe")] if source else []))
    return out.na.drop(subset=["date", "debenture_id"])
