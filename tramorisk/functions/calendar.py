"""Months, shifts and dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The four six-hour shifts in clock order.
SHIFTS = ("madrugada", "manana", "tarde", "noche")
# Hour that stands for a shift when the clock hour is unknown.
SHIFT_MIDPOINT = {"madrugada": 2, "manana": 9, "tarde": 15, "noche": 21}
# Month names of both source languages and their numbers.
MONTH_NUMBERS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06",
    "julio": "07", "agosto": "08", "septiembre": "09", "setiembre": "09", "octubre": "10",
    "noviembre": "11", "diciembre": "12",
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06",
    "july": "07", "august": "08", "september": "09", "october": "10", "november": "11",
    "december": "12",
}
# Spanish names written to the clean table.
MONTH_NAMES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
               "septiembre", "octubre", "noviembre", "diciembre")
WEEKDAY_NAMES = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")


@dataclass(frozen=True)
class Calendar:
    """Closed range of months; ``mes_idx`` counts from its first month."""

    first: str
    last: str

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("calendar ends before it starts")

    @property
    def size(self) -> int:
        return self.index(self.last) + 1

    def index(self, period: str) -> int:
        year, month = map(int, period.split("-"))
        year0, month0 = map(int, self.first.split("-"))
        return (year - year0) * 12 + month - month0

    def period(self, index: int) -> str:
        year0, month0 = map(int, self.first.split("-"))
        total = year0 * 12 + month0 - 1 + index
        return f"{total // 12:04d}-{total % 12 + 1:02d}"

    def periods(self) -> list[str]:
        return [self.period(i) for i in range(self.size)]

    def index_of(self, period: Column) -> Column:
        """``mes_idx`` of a ``yyyy-MM`` text column."""
        year0, month0 = map(int, self.first.split("-"))
        months = F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int")
        return (months - F.lit(year0 * 12 + month0)).cast("int")

    def period_of(self, index: Column) -> Column:
        return F.date_format(F.add_months(F.to_date(F.lit(self.first + "-01")), index), "yyyy-MM")

    def months(self, spark: SparkSession) -> DataFrame:
        """Month dimension ``mes_idx, periodo, mes_num``."""
        base = spark.range(self.size).select(F.col("id").cast("int").alias("mes_idx"))
        return base.select("mes_idx", self.period_of(F.col("mes_idx")).alias("periodo")).withColumn(
            "mes_num", F.substring("periodo", 6, 2).cast("int"))


def shift_of_hour(hour: Column) -> Column:
    """Shift name of a clock hour 0-23."""
    names = F.array(*[F.lit(s) for s in SHIFTS])
    return F.element_at(names, (F.floor(hour / 6) + 1).cast("int"))


def shift_index(shift: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SHIFTS]), shift) - 1).cast("int")


def shift_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), (index + 1).cast("int"))


def shift_at(moment: Column, zone: str = "America/Lima") -> Column:
    """Shift of a UTC timestamp on the local clock."""
    return shift_of_hour(F.hour(F.from_utc_timestamp(moment, zone)))


def lenient_shift(column: Column) -> Column:
    """Known shift name, or ``noche``."""
    from tramorisk.functions.text import normalize_text

    name = F.lower(normalize_text(column))
    return F.when(name.isin(*SHIFTS), name).otherwise(F.lit("noche"))


def strict_shift(column: Column) -> Column:
    """Known shift name, or an error at run time."""
    from tramorisk.functions.text import normalize_text

    name = F.lower(normalize_text(column, default=None))
    fail = F.raise_error(F.concat(F.lit("unexpected shift: "), F.coalesce(column, F.lit("NULL"))))
    return F.when(name.isin(*SHIFTS), name).otherwise(fail.cast("string"))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of three text parts; a thousands comma in the year is dropped."""
    y = F.replace(F.trim(year.cast("string")), F.lit(","), F.lit("")).try_cast("int")
    zero = F.lit(0)
    return F.try_make_timestamp(y, F.trim(month.cast("string")).try_cast("int"),
                                F.trim(day.cast("string")).try_cast("int"), zero, zero, zero.cast("decimal(8,6)"))


# Layouts accepted for free-text dates, tried in this order.
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                "yyyy/MM/dd", "MM d, yyyy", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "d MM yyyy", "d 'de' MM 'de' yyyy")


def date_from_text(column: Column) -> Column:
    """Timestamp of a text with Spanish or English month names."""
    text = F.lower(F.trim(column.cast("string")))
    for name, number in MONTH_NUMBERS.items():
        text = F.replace(text, F.lit(name), F.lit(number))
    text = F.upper(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout.replace("'de'", "'DE'"))) for layout in DATE_LAYOUTS])


def clock_hour(text: Column, shift: Column) -> Column:
    """First one or two digits as the hour, else the middle of the shift."""
    digits = F.regexp_extract(text.cast("string"), r"(\d{1,2})", 1).try_cast("int")
    middle = F.coalesce(*[F.when(shift == name, F.lit(hour)) for name, hour in SHIFT_MIDPOINT.items()])
    return F.least(F.greatest(F.coalesce(digits, middle), F.lit(0)), F.lit(23)).cast("int")


def month_name(moment: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(moment))


def weekday_name(moment: Column) -> Column:
    names = F.array(*[F.lit(d) for d in WEEKDAY_NAMES])
    return F.coalesce(F.element_at(names, F.weekday(moment) + 1), F.lit("desconocido"))


def cyclic(position: Column, length: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a circle of ``length`` steps."""
    angle = F.lit(2 * 3.141592653589793) * position / F.lit(float(length))
    return F.sin(angle), F.cos(angle)
