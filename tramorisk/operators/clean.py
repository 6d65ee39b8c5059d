"""Cleaning, filtering and deduplication of incident records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions import calendar as cal, geo
from tramorisk.functions.severity import category, configured_severity
from tramorisk.functions.text import decimal_number, first_non_empty, normalize_text
from tramorisk.operators.ordered import first_by
from tramorisk.operators.panel import count_where

# Columns accepted for each field of a legacy file, best first.
ALIASES = {
    "latitud": ("lat_hecho", "y", "latitud", "lat"),
    "longitud": ("long_hecho", "x", "longitud", "lng", "lon"),
    "distrito": ("distrito_hecho", "distrito"),
    "provincia": ("provincia_hecho", "provincia"),
    "departamento": ("departamento_hecho", "departamento"),
    "tipo_delito": ("tipo_hecho", "tipo_delito", "tipo"),
    "subtipo_delito": ("subtipo_hecho", "subtipo_delito", "subtipo"),
    "modalidad": ("modalidad_hecho", "modalidad"),
    "turno": ("turno_hecho", "turno"),
    "hora": ("hora_hecho", "hora"),
    "fecha": ("fecha_hora_hecho", "fecha_hora_registro_hecho", "fecha"),
}
# Identifier and year columns of legacy files.
ID_COLUMNS = ("GlobalID", "globalid", "id_dgc", "ID_DGC_03", "OBJECTID")
YEAR_COLUMNS = ("año_hecho", "anio_hecho", "aÃ±o_hecho")
# Codes kept by the relevance filter.
RELEVANT_SUBTYPES = ("10101", "10103", "10401", "10409", "10501", "10502", "10508", "11201", "13002", "13003",
                     "50801", "70101", "70102", "70104", "70704", "71001", "71002", "71101", "71102")
RELEVANT_MODALITIES = ("1140109", "5040124", "5040125")
# Texts that mean "no value".
BLANK_WORDS = ("", "NA", "N/A", "NULL", "NONE", "NAN")
# Headers a yearly source must carry.
REQUIRED_HEADERS = ("id_doc_denuncia", "FECHA_HORA_HECHO", "DIST_HECHO", "xx", "yy", "TIPO", "ID_SUBTIPO",
                    "SUB_TIPO", "ID_MODALIDAD", "MODALIDAD", "TURNO")
NORMAL_FIELDS = ("id_hecho", "fecha_hora_hecho", "fecha", "periodo", "hora", "latitud", "longitud", "turno",
                 "tipo_delito", "subtipo_delito", "modalidad", "id_subtipo", "id_modalidad", "distrito",
                 "peso_delito", "categoria_delito")


def first_column(df: DataFrame, names: Sequence[str]) -> Column:
    """First existing column among aliases; empty text if none exists."""
    for name in names:
        if name in df.columns:
            return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return F.lit("")


def identifier(df: DataFrame, row_key: Column, names: Sequence[str] = ID_COLUMNS) -> Column:
    """First non-blank identifier of the row, else ``FILA-<row>``."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    fallback = F.concat(F.lit("FILA-"), row_key.cast("string"))
    return F.coalesce(first_non_empty(*present), fallback) if present else fallback


def require_headers(df: DataFrame, required: Sequence[str] = REQUIRED_HEADERS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def clean_legacy(df: DataFrame, row_key: Column | None = None) -> DataFrame:
    """Typed incidents inside the city box, one per identifier."""
    row_key = F.monotonically_increasing_id() if row_key is None else row_key
    raw = df.withColumn("_fila", row_key)
    pick = {field: first_column(raw, names) for field, names in ALIASES.items()}
    texts = ("distrito", "provincia", "departamento", "tipo_delito", "subtipo_delito", "modalidad")
    out = raw.select(
        "_fila", identifier(raw, F.col("_fila")).alias("id_hecho"),
        decimal_number(pick["latitud"]).alias("latitud"), decimal_number(pick["longitud"]).alias("longitud"),
        *[normalize_text(pick[t]).alias(t) for t in texts], cal.lenient_shift(pick["turno"]).alias("turno"),
        _legacy_date(raw, pick["fecha"]).alias("fecha"), pick["hora"].alias("_hora"))
    out = out.withColumn("hora", cal.clock_hour(F.col("_hora"), F.col("turno"))).drop("_hora")
    out = with_calendar(out)
    out = out.dropna(subset=["latitud", "longitud", "fecha"]).filter(geo.inside_box(F.col("latitud"), F.col("longitud")))
    return first_by(out, ["id_hecho"], [F.col("_fila")]).drop("_fila")


def _legacy_date(df: DataFrame, text: Column) -> Column:
    year = next((c for c in YEAR_COLUMNS if c in df.columns), None)
    from_text = cal.date_from_text(text)
    if year and {"mes_hecho", "dia_hecho"} <= set(df.columns):
        return F.coalesce(cal.date_from_parts(F.col(f"`{year}`"), F.col("mes_hecho"), F.col("dia_hecho")), from_text)
    return from_text


def with_calendar(df: DataFrame, moment: str = "fecha") -> DataFrame:
    """Year, month, day, period and Spanish names of a timestamp column."""
    t = F.col(moment)
    return (df.withColumn("anio", F.year(t)).withColumn("mes", F.month(t)).withColumn("mes_nombre", cal.month_name(t))
            .withColumn("dia", F.dayofmonth(t)).withColumn("periodo", F.date_format(t, "yyyy-MM"))
            .withColumn("dia_semana", cal.weekday_name(t)))


def normalize_yearly(df: DataFrame, year: int | Column, strict: bool = True) -> DataFrame:
    """Rows of one yearly source with scores; unlocated rows keep NULL places.

    In strict mode a wrong year, an unknown shift or a place outside the wide
    box stops the job, as bad source files must be repaired, not skipped.
    """
    require_headers(df)
    year = year if isinstance(year, Column) else F.lit(year)
    event = F.trim("FECHA_HORA_HECHO")
    moment = F.try_to_timestamp(event, F.lit("yyyy/MM/dd HH:mm:ss"))
    lat, lon = decimal_number(F.col("xx")), decimal_number(F.col("yy"))
    located = (F.trim(F.coalesce("xx", F.lit(""))) != "") & (F.trim(F.coalesce("yy", F.lit(""))) != "")
    out = df.select(
        F.trim("id_doc_denuncia").alias("id_hecho"), event.alias("fecha_hora_hecho"),
        F.date_format(moment, "yyyy-MM-dd").alias("fecha"), F.date_format(moment, "yyyy-MM").alias("periodo"),
        F.hour(moment).alias("hora"), F.when(located, lat).alias("latitud"), F.when(located, lon).alias("longitud"),
        (cal.strict_shift(F.col("TURNO")) if strict else cal.lenient_shift(F.col("TURNO"))).alias("turno"),
        F.trim("TIPO").alias("tipo_delito"), F.trim("SUB_TIPO").alias("subtipo_delito"), F.trim("MODALIDAD").alias("modalidad"),
        F.trim("ID_SUBTIPO").alias("id_subtipo"), F.trim("ID_MODALIDAD").alias("id_modalidad"),
        F.trim("DIST_HECHO").alias("distrito"),
        configured_severity(F.trim("ID_SUBTIPO"), F.trim("ID_MODALIDAD"), F.col("SUB_TIPO"), F.col("MODALIDAD")).alias("peso_delito"),
        category(F.col("SUB_TIPO"), F.col("MODALIDAD")).alias("categoria_delito"),
        (F.year(moment) == year).alias("_anio_ok"))
    if not strict:
        return out.filter(F.coalesce("_anio_ok", F.lit(False))).drop("_anio_ok")
    checks = F.when(~F.coalesce("_anio_ok", F.lit(False)), F.raise_error(F.concat(F.lit("bad event date: "), F.coalesce("fecha_hora_hecho", F.lit("NULL"))))).when(
        F.col("latitud").isNotNull() & ~geo.inside_box(F.col("latitud"), F.col("longitud"), geo.WIDE_BOX),
        F.raise_error(F.lit("place outside the wide box")))
    return out.withColumn("periodo", F.coalesce(checks.cast("string"), F.col("periodo"))).drop("_anio_ok")


def keep_first_by_id(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_by(df, [key], order)


def keep_first_by_content(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each distinct content; the whole content is the key."""
    return first_by(df, list(columns), order)


def relevant(subtype_code: Column, modality_code: Column) -> Column:
    return subtype_code.isin(*RELEVANT_SUBTYPES) | modality_code.isin(*RELEVANT_MODALITIES)


def repaired_coordinate(raw: Column) -> tuple[Column, Column]:
    """Value and repaired flag; a lost decimal point returns after two digits."""
    text = F.replace(F.trim(raw), F.lit(","), F.lit("."))
    value = F.when(~F.upper(text).isin(*BLANK_WORDS), text.try_cast("double"))
    lost = text.rlike(r"^-\d{4,17}$") & (F.abs(value) > 180)
    moved = F.concat(F.substring(text, 1, 3), F.lit("."), F.substring(text, 4, 30)).try_cast("double")
    return F.when(lost, moved).otherwise(value), F.coalesce(lost, F.lit(False))


def repaired_place(lat_raw: Column, lon_raw: Column) -> tuple[Column, Column, Column]:
    """Latitude and longitude texts with seven decimals, and the place status."""
    lat, lat_fixed = repaired_coordinate(lat_raw)
    lon, lon_fixed = repaired_coordinate(lon_raw)
    status = (F.when(lat.isNull() | lon.isNull(), "missing")
              .when(~geo.inside_box(lat, lon, geo.WIDE_BOX), "outside_lima_callao")
              .when(lat_fixed | lon_fixed, "decimal_recovered").otherwise("valid"))
    good = status.isin("valid", "decimal_recovered")
    show = lambda v: F.when(good, F.format_string("%.7f", v)).otherwise(F.lit(""))
    return show(lat), show(lon), status


def valid_event(raw: Column, year: Column) -> Column:
    """Text holds a timestamp of the given year."""
    text = F.replace(F.trim(raw), F.lit("/"), F.lit("-"))
    moment = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
                        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.year(moment) == year, F.lit(False))


def filter_with_funnel(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the yearly funnel with its grand total.

    Input columns: anio, orden, id, fecha_registro, fecha_hecho, lat, lon,
    subtipo, modalidad (all text but anio and orden). The funnel counts each
    reason once and balances: selected = output + invalid + duplicate.
    """
    lat, lon, status = repaired_place(F.col("lat"), F.col("lon"))
    marked = df.withColumn("_sel", F.coalesce(relevant(F.trim("subtipo"), F.trim("modalidad")), F.lit(False))).withColumn(
        "_ok", (F.trim(F.coalesce("id", F.lit(""))) != "") & valid_event(F.col("fecha_hecho"), F.col("anio"))).withColumn(
        "geo_estado", status).withColumn("lat_limpia", lat).withColumn("lon_limpia", lon)
    content = ["anio", "id", "fecha_registro", "fecha_hecho", "lat", "lon", "subtipo", "modalidad"]
    passed = marked.filter("_sel AND _ok")
    kept = keep_first_by_content(passed, content, [F.col("orden")])
    kept_count = kept.groupBy("anio").agg(F.count(F.lit(1)).alias("output_rows"))
    seen = marked.groupBy("anio").agg(
        F.count(F.lit(1)).alias("source_rows"), count_where(F.col("_sel")).alias("selected_crimes"),
        count_where(~F.col("_sel")).alias("excluded_other_typification"),
        count_where(F.col("_sel") & ~F.col("_ok")).alias("excluded_invalid"),
        *[count_where(F.col("_sel") & F.col("_ok") & (F.col("geo_estado") == s)).alias(f"geo_{s}")
          for s in ("valid", "decimal_recovered", "missing", "outside_lima_callao")])
    yearly = seen.join(kept_count, "anio", "left").fillna(0, ["output_rows"])
    names = [c for c in yearly.columns if c != "anio"]
    funnel = yearly.rollup("anio").agg(*[F.sum(c).alias(c) for c in names]).withColumn(
        "excluded_duplicate", F.col("selected_crimes") - F.col("excluded_invalid") - F.col("output_rows"))
    return kept.drop("_sel", "_ok"), funnel


def filter_records(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Keep rows matching every given value; None, empty and ``todos`` are open."""
    for column, value in wanted.items():
        if value and value != "todos":
            df = df.filter(F.col(column) == value)
    return df
