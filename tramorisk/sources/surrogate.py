"""Incident, road, light and forecast tables derived from the bundled tables.

Integer arithmetic first, then one multiplication by a double, so that every
engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tramorisk.functions.calendar import Calendar, shift_name
from tramorisk.functions.severity import score_incidents

CALENDAR = Calendar("1995-01", "2001-12")
# Texts taken in turn by the surrogate incidents.
MODALITIES = ("Robo agravado", "HURTO", "Extorsión", "HOMICIDIO SIMPLE", "robo de celular", "SECUESTRO",
              "lesiones", "Hurto agravado")
SUBTYPES = ("ROBO", "HURTO", "EXTORSION", "OTROS")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lat(k: str) -> str:
    return f"-12.20D + 0.0018D * (({k}) div 32)"


def _lon(k: str) -> str:
    return f"-77.10D + 0.0018D * (({k}) % 32)"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Road segments: H joins a node to the next, V to the one a row above."""
    base = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"))
    both = base.select("k", F.explode(F.expr(
        "filter(array(struct('H' AS t, k + 1 AS v), struct('V' AS t, k + 32 AS v)), s -> s.t = 'V' OR k % 32 <> 31)"
    )).alias("s"))
    both = both.select(
        F.concat("s.t", "k").alias("tramo_id"), F.col("k").alias("u"), F.col("s.v").alias("v"),
        F.expr("(60 + (k * 37) % 240) * 1.0D").alias("longitud_m"),
        F.expr(_lat("k")).alias("lat_u"), F.expr(_lon("k")).alias("lon_u"),
        F.expr(_lat("s.v")).alias("lat_v"), F.expr(_lon("s.v")).alias("lon_v"), "k")
    bend = both.withColumn("lat_c", F.expr("(lat_u + lat_v) / 2.0D + ((k * 7) % 11 - 5) * 0.00003D")).withColumn(
        "lon_c", F.expr("(lon_u + lon_v) / 2.0D + ((k * 13) % 11 - 5) * 0.00003D"))
    return bend.select(
        "tramo_id", "u", "v", "longitud_m",
        F.expr("(lat_u + lat_v) / 2.0D").alias("latitud"), F.expr("(lon_u + lon_v) / 2.0D").alias("longitud"),
        F.expr("array(struct(lon_u AS lon, lat_u AS lat), struct(lon_c AS lon, lat_c AS lat), "
               "struct(lon_v AS lon, lat_v AS lat))").alias("puntos"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    ends = segments(spark, folder).select(F.explode(F.array("u", "v")).alias("nodo")).distinct()
    return ends.select("nodo", F.expr(_lat("nodo")).alias("lat"), F.expr(_lon("nodo")).alias("lon"))


def raw_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents before scoring; ``geo`` tells whether the place is known."""
    kinds = ", ".join(f"'{m}'" for m in MODALITIES)
    subs = ", ".join(f"'{s}'" for s in SUBTYPES)
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id_hecho",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) AS fila",
        "l_shipdate AS fecha",
        "date_format(l_shipdate, 'yyyy-MM') AS periodo",
        "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS mes_idx",
        "CAST((l_partkey * 7 + l_linenumber * 5) % 24 AS INT) AS hora",
        "CAST(((l_partkey * 7 + l_linenumber * 5) % 24) div 6 AS INT) AS turno_idx",
        f"{_lat('l_suppkey')} + ((l_orderkey % 41) - 20) * 0.00002D AS latitud",
        f"{_lon('l_suppkey')} + ((l_partkey % 41) - 20) * 0.00002D AS longitud",
        f"element_at(array({kinds}), CAST(l_partkey % 8 + 1 AS INT)) AS modalidad",
        f"element_at(array({subs}), CAST(l_orderkey % 4 + 1 AS INT)) AS subtipo",
        "NOT (l_partkey % 11 = 0 OR (month(l_shipdate) = 2 AND l_partkey % 2 = 0)) AS geo",
        "concat(CASE WHEN l_suppkey % 32 = 31 OR l_orderkey % 2 = 0 THEN 'V' ELSE 'H' END, l_suppkey) AS tramo_id",
        "CAST(l_suppkey AS STRING) AS distrito",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Scored incidents with shift names."""
    return score_incidents(raw_incidents(spark, folder).withColumn("turno", shift_name(F.col("turno_idx"))))


def lights(spark: SparkSession, folder: str) -> DataFrame:
    """Street lights with their day of service, around the supplier nodes."""
    n = table(spark, folder, "supplier").count()
    base = table(spark, folder, "part").withColumn("k", F.col("p_partkey") % n)
    return base.selectExpr(
        "p_partkey AS codluminaria", "CAST(p_partkey % 3 AS INT) AS codemp",
        f"{_lat('k')} + ((p_partkey * 13) % 61 - 30) * 0.00001D AS lat",
        f"{_lon('k')} + ((p_partkey * 13) % 61 - 30) * 0.00001D AS lon",
        "date_add(DATE'1995-01-01', CAST((p_partkey * 13) % 2500 AS INT)) AS servicio",
        "concat('corte-', p_size % 3) AS fecha_corte")


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Three-class forecasts with a truth label, one row per order."""
    base = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", "date_format(o_orderdate, 'yyyy-MM') AS periodo",
        "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS mes_idx",
        "CAST(o_orderkey % 4 AS INT) AS turno_idx", "concat('T', o_custkey) AS tramo_id",
        "(o_orderkey * 37) % 101 + 1 AS a", "(o_orderkey * 53) % 97 + 1 AS b", "(o_orderkey * 71) % 89 + 1 AS c")
    return base.selectExpr(
        "id", "tramo_id", "periodo", "mes_idx", "turno_idx",
        "(100 - (b * 100) div (a + b + c) - (c * 100) div (a + b + c)) / 100.0D AS p0",
        "((b * 100) div (a + b + c)) / 100.0D AS p1", "((c * 100) div (a + b + c)) / 100.0D AS p2",
        "CASE WHEN c * 2 > a + b - 20 + (o_custkey % 60) THEN 2 WHEN b > a - (o_custkey % 40) THEN 1 ELSE 0 END AS y")


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast score of each segment from its incident history, 0 to 1."""
    history = incidents(spark, folder).groupBy("tramo_id").agg(
        F.sum("peso").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("grave").alias("g"))
    base = segments(spark, folder).select("tramo_id", "u", "v", "latitud", "longitud", "longitud_m", "puntos")
    return base.join(history, "tramo_id", "left").selectExpr(
        "tramo_id", "u", "v", "latitud", "longitud", "longitud_m", "puntos",
        "((coalesce(s, 0) * 31 + coalesce(n, 0) * 17 + coalesce(g, 0) * 7 + u * 13) % 1001) / 1000.0D AS riesgo_score")


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Origin and destination node of every customer."""
    n = table(spark, folder, "supplier").count()
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS od", f"c_custkey % {n} AS origen", f"(c_custkey * 17 + 5) % {n} AS destino")
