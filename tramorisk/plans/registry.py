"""Query registry: a Spark job, its columns and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tramorisk.functions.calendar import Calendar
from tramorisk.operators import panel, spatial
from tramorisk.session import settle
from tramorisk.sources import surrogate

_QUERIES: dict[str, tuple[str, Callable[["Tables"], DataFrame]]] = {}
_ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}
_SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT"}


class Tables:
    """Input tables of one run, as lazily built DataFrames."""

    calendar: Calendar = surrogate.CALENDAR

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return surrogate.table(self.spark, self.folder, name)

    def raw(self) -> DataFrame:
        return surrogate.raw_incidents(self.spark, self.folder)

    def incidents(self) -> DataFrame:
        return surrogate.incidents(self.spark, self.folder)

    def placed(self) -> DataFrame:
        """Located incidents with metric coordinates."""
        return spatial.with_xy(self.incidents().filter("geo"))

    def segments(self) -> DataFrame:
        return surrogate.segments(self.spark, self.folder)

    def lines(self) -> DataFrame:
        return spatial.with_xy(spatial.with_pieces(self.segments()))

    def nodes(self) -> DataFrame:
        return surrogate.nodes(self.spark, self.folder)

    def cube(self) -> DataFrame:
        return panel.shift_cube(self.incidents().filter("geo"))

    def dense_cube(self) -> DataFrame:
        return panel.dense(self.cube(), self.segments(), self.calendar, shifts=True, keep=("latitud", "longitud", "longitud_m"))

    def dense_months(self) -> DataFrame:
        """Dense monthly panel with the published measure names."""
        monthly = self.incidents().filter("geo").groupBy("tramo_id", "mes_idx").agg(
            *panel.monthly_panel_measures(F.col("peso")))
        return panel.dense(monthly, self.segments(), self.calendar, keep=("latitud", "longitud", "longitud_m"))

    def months(self) -> DataFrame:
        return panel.observed_months(panel.coverage(self.raw()), self.calendar)

    def lights(self) -> DataFrame:
        return surrogate.lights(self.spark, self.folder)

    def proba(self) -> DataFrame:
        return surrogate.probabilities(self.spark, self.folder)

    def forecasts(self) -> DataFrame:
        return surrogate.forecasts(self.spark, self.folder)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several queries share, written once per session and input."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            _STORED[key] = settle(build())
        return _STORED[key]

    def trips(self) -> DataFrame:
        return surrogate.trips(self.spark, self.folder)


def _columns(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in text.split()]


def rounded(value: Column, places: int) -> Column:
    """``F.round`` of a double, bit by bit but with 0 for -0, without its decimal text where the nearest step is beyond doubt.

    ``round`` writes each value as text and parses it again, which took most of the time of wide panels. Off the
    middle of two steps the whole number of steps is certain, and its quotient is the double nearest to the decimal.
    """
    scale = float(10 ** places)
    steps = F.rint(value * scale)
    sure = (F.abs(value * scale - steps) < 0.499) & (F.abs(steps) < 1e11)
    return F.when(sure, steps / scale).otherwise(F.round(value, places)) + F.lit(0.0)


def rounding(places: int) -> Callable[[Column], Column]:
    return lambda value: rounded(value, places)


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """Declared columns with declared types; doubles rounded for comparison."""
    names = dict(_columns(columns))
    places: dict[int, list[str]] = {}
    for name, kind in names.items():
        if kind.startswith("d"):
            places.setdefault(int(kind[1:] or 6), []).append(name)
    plain = [F.col(name).cast({"s": "string", "l": "bigint"}[kind]).alias(name) for name, kind in names.items() if kind in _SQL_TYPES]
    # One short lambda for all doubles: written out column by column, the code of a wide table is too long to be compiled.
    arrays = [F.transform(F.array(*[F.col(n).cast("double") for n in found]), rounding(p)).alias(f"_d{p}") for p, found in places.items()]
    at = {name: F.col(f"_d{p}")[i].alias(name) for p, found in places.items() for i, name in enumerate(found)}
    return df.select(*plain, *arrays).select(*[at.get(name, F.col(name)) for name in names])


def _shaped_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _columns(columns):
        if kind.startswith("d"):
            value = f"round(q.{name}::DOUBLE, {int(kind[1:] or 6)})"
            out.append(f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END AS {name}")
        else:
            out.append(f"q.{name}::{_SQL_TYPES[kind]} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) q"


def query(name: str, columns: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = (columns, build)
        if sql:
            _ORACLES[name] = _shaped_sql(sql, columns)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(columns: str, build):
        return lambda spark, folder: shaped(build(Tables(spark, folder)), columns)

    return {name: runner(*entry) for name, entry in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
