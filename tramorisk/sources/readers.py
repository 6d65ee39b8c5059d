"""Readers and writers: delimited text, yearly sources, panels, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tramorisk.session import settle


def delimiter_of(spark: SparkSession, path: str) -> str:
    """``;`` if the first line holds more of them than commas."""
    line = spark.read.text(path).first()
    text = line[0] if line else ""
    return ";" if text.count(";") > text.count(",") else ","


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns of a delimited file with header; a byte-order mark is dropped."""
    df = spark.read.csv(path, sep=delimiter_of(spark, path), header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_years(spark: SparkSession, paths: dict[int, str], moment: str = "FECHA_HORA_HECHO", layout: str = "yyyy/MM/dd HH:mm:ss") -> tuple[DataFrame, DataFrame]:
    """One delimited source per year: its rows with ``anio``, and the lines that are no rows of it.

    Rejected lines come as ``anio``, ``motivo`` and ``linea``: a line with too many
    or too few fields, one without a readable moment, one of another year.
    Every line read is in one of the two tables.
    """
    frames = []
    for year, path in sorted(paths.items()):
        sep = delimiter_of(spark, path)
        head = spark.read.text(path).first()
        names = head[0].lstrip("\ufeff").split(sep) if head else [moment]
        schema = ", ".join(f"`{n}` string" for n in [*names, "_linea"])
        rows = spark.read.csv(path, sep=sep, header=True, schema=schema, encoding="UTF-8", mode="PERMISSIVE", columnNameOfCorruptRecord="_linea")
        frames.append(rows.withColumn("anio", F.lit(year)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, True)
    out = settle(out)  # whole lines are parsed once; a reader of a few columns would not see that a line is malformed
    own = F.year(F.try_to_timestamp(F.trim(moment), F.lit(layout)))
    reason = F.when(F.col("_linea").isNotNull(), "malformada").when(own.isNull(), "sin fecha").when(own != F.col("anio"), "otro anio")
    judged = out.withColumn("motivo", reason)
    names = [c for c in out.columns if c not in ("_linea", "anio")]
    rejected = judged.filter("motivo is not null").select("anio", "motivo", F.coalesce("_linea", F.concat_ws(";", *names)).alias("linea"))
    return judged.filter("motivo is null").drop("_linea", "motivo"), rejected


def tagged_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of sources with their name in ``fuente``."""
    tagged = [df.withColumn("fuente", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for frame in tagged[1:]:
        out = out.unionByName(frame)
    return out


def only_periods(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.filter(F.col("periodo").between(first, last))


def write_partitioned(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """Parquet by partition columns; crowded partitions are split, thin ones merged."""
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_manifest(df: DataFrame) -> DataFrame:
    """Path, size and time of every file a DataFrame reads."""
    meta = F.col("_metadata")
    return df.select(meta["file_path"].alias("archivo"), meta["file_size"].alias("bytes"),
                     meta["file_modification_time"].cast("string").alias("modificado")).distinct()


def fingerprint(df: DataFrame, spec: dict) -> str:
    """Digest of the input files and the job specification.

    The file list is reduced to one order-free hash on the executors.
    """
    files = file_manifest(df).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("archivo", "bytes", "modificado").cast("decimal(38,0)")).alias("h")).first()
    text = json.dumps({"n": files["n"], "h": str(files["h"]), "spec": spec}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at ``path``; any other failure of the store is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored_fingerprint(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path).first()[0] if exists(spark, path) else None


def reusable(spark: SparkSession, path: str, expected: str, allow_replace: bool = True) -> bool:
    """True if the stored stage has the expected fingerprint.

    With ``allow_replace`` off, a different fingerprint is an error.
    """
    found = stored_fingerprint(spark, path)
    if found is not None and found != expected and not allow_replace:
        raise ValueError("the source or the rules changed; use another version of the experiment")
    return found == expected


def store_fingerprint(spark: SparkSession, path: str, value: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content digest of a table."""
    return df.agg(F.count(F.lit(1)).alias("filas"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("huella"))


def register_forecast(spark: SparkSession, forecast: DataFrame, path: str, period: str, columns: Sequence[str],
                      now: datetime | None = None, offset_hours: int = 5) -> DataFrame:
    """Store a forecast once per period, then its content digest, which marks it as registered.

    A period already registered is an error, as a registered forecast is frozen,
    and so is one that has begun by ``now`` (first moment of the month, UTC, plus
    ``offset_hours``). Rows without a digest were left by a failed run and are
    replaced. Two runs at once cannot both write the digest.
    """
    mark = f"{path}/registro/periodo={period}"
    if exists(spark, mark):
        raise ValueError(f"the forecast of {period} is already registered")
    begins = datetime.strptime(period, "%Y-%m").replace(tzinfo=timezone.utc) + timedelta(hours=offset_hours)
    if now is not None and now >= begins:
        raise ValueError(f"{period} has begun; its forecast is late")
    rows = f"{path}/filas/periodo={period}"
    forecast.write.mode("overwrite").parquet(rows)
    stored = spark.read.schema(forecast.schema).parquet(rows)
    table_digest(stored, columns).withColumn("registrado", F.current_timestamp()).write.mode("errorifexists").parquet(mark)
    return registered_forecasts(spark, path).filter(F.col("periodo") == period)


def registered_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Periods with their number of rows, digest and time of registration."""
    return spark.read.schema("filas long, huella string, registrado timestamp, periodo string").parquet(f"{path}/registro")


def model_catalog(spark: SparkSession, folder: str, names: dict[str, str], default: str) -> DataFrame:
    """Metrics and metadata of the exported models that exist in a folder."""
    rows = []
    for key, name in names.items():
        path = f"{folder}/metricas_{key}.csv"
        if not exists(spark, path):
            continue
        metrics = read_delimited(spark, path).first()
        rows.append((key, name, key == default, json.dumps(metrics.asDict(), ensure_ascii=False)))
    return spark.createDataFrame(rows, "clave string, nombre string, por_defecto boolean, metricas string")


def metric_rows(wide: DataFrame, key: str) -> DataFrame:
    """Long table ``key, metrica, valor`` of a wide metric table."""
    names = [c for c, kind in wide.dtypes if c != key and kind in ("double", "bigint", "int", "float")]
    rows = F.array(*[F.struct(F.lit(c).alias("metrica"), F.col(c).cast("double").alias("valor")) for c in names])
    return wide.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def in_box(df: DataFrame, lat: Column, lon: Column, box: tuple[float, float, float, float]) -> DataFrame:
    south, north, west, east = box
    return df.filter(lat.between(south, north) & lon.between(west, east))
