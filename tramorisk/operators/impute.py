"""Coordinates for incidents that lack them, from donor records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.functions.geo import separation_m
from tramorisk.operators.ordered import HOT_ROWS, first_by, global_rank, salted_join
from tramorisk.session import spread, written

MAX_HOURS = 6
MAX_SPREAD_M = 20.0
# Donor levels from the closest match to the widest.
DONOR_LEVELS = (
    ("mes_subtipo_turno", ("anio", "distrito", "mes", "subtipo", "turno")),
    ("mes_subtipo", ("anio", "distrito", "mes", "subtipo")),
    ("mes_tipo_turno", ("anio", "distrito", "mes", "tipo", "turno")),
    ("mes_tipo", ("anio", "distrito", "mes", "tipo")),
    ("mes_turno", ("anio", "distrito", "mes", "turno")),
    ("mes", ("anio", "distrito", "mes")),
    ("anio_distrito", ("anio", "distrito")),
)
# Columns whose cells travel together; a level holds them all or only some of them.
CELL_GROUP = ("anio", "distrito", "mes")


def donors_for(missing: DataFrame, located: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Located rows sharing a full key with some missing row."""
    wanted = missing.select(*keys).dropna().distinct()
    for k in keys:
        wanted = wanted.filter(F.trim(F.col(k).cast("string")) != "")
    return located.join(wanted, list(keys), "left_semi")


def same_report(missing: DataFrame, donors: DataFrame, keys: Sequence[str], hours: float = MAX_HOURS,
                max_spread_m: float = MAX_SPREAD_M) -> DataFrame:
    """Nearest donor in time of the same report, if its donors agree in place.

    Inputs carry ``keys``, ``momento`` (timestamp) and ``fila`` (total order);
    donors add ``latitud, longitud``. Rows that ask for the same key and
    second get the same answer, so both sides are reduced to distinct seconds
    and places before they meet. A time slot as long as the reach lies wholly
    inside the window of each of its seconds: when the donors of that slot
    spread over more than twice the limit the answer is already "ambiguo".
    """
    keys = list(keys)
    reach = int(hours * 3600)
    slot = lambda: F.floor(F.unix_timestamp("momento") / reach).alias("_slot")
    asked = missing.select(*keys, F.unix_timestamp("momento").alias("_t"), slot()).distinct()
    offered = donors.groupBy(*keys, F.unix_timestamp("momento").alias("_s"), slot(), "latitud", "longitud").agg(
        F.count(F.lit(1)).alias("_n"), F.min("fila").alias("_fila"))
    box = offered.groupBy(*keys, "_slot").agg(
        F.min("latitud").alias("_la"), F.max("latitud").alias("_lb"), F.min("longitud").alias("_oa"), F.max("longitud").alias("_ob"))
    wide = F.greatest(separation_m(F.col("_la"), F.col("_oa"), F.col("_lb"), F.col("_oa")),
                      separation_m(F.col("_la"), F.col("_oa"), F.col("_la"), F.col("_ob"))) > 2 * max_spread_m
    asked = asked.join(box.select(*keys, "_slot", wide.alias("_wide")), [*keys, "_slot"], "left")
    ambiguous = asked.filter("_wide").select(*keys, "_t", F.lit("ambiguo").alias("estado"))
    open_ = asked.filter(~F.coalesce("_wide", F.lit(False))).withColumn(
        "_slot", F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)))
    pairs = salted_join(offered, open_.select(*keys, "_t", "_slot"), [*keys, "_slot"]).filter(
        F.abs(F.col("_s") - F.col("_t")) <= reach)
    chosen = pairs.groupBy(*keys, "_t").agg(
        F.sum("_n").alias("donantes"),
        F.min(F.struct(F.abs(F.col("_s") - F.col("_t")).alias("d"), "_fila", "latitud", "longitud")).alias("_m"))
    chosen = chosen.select(*keys, "_t", "donantes", F.col("_m.latitud").alias("lat_rec"), F.col("_m.longitud").alias("lon_rec"),
                           F.col("_m._fila").alias("fila_donante"), (F.col("_m.d") / 3600.0).alias("horas"))
    apart = separation_m(F.col("lat_rec"), F.col("lon_rec"), F.col("latitud"), F.col("longitud"))
    spread = pairs.join(chosen.select(*keys, "_t", "lat_rec", "lon_rec"), [*keys, "_t"]).groupBy(*keys, "_t").agg(
        F.max(apart).alias("dispersion_m"))
    found = chosen.join(spread, [*keys, "_t"])
    found = found.withColumn("estado", F.when(F.col("dispersion_m") > max_spread_m, "ambiguo").otherwise("recuperado"))
    answers = found.unionByName(ambiguous, allowMissingColumns=True)
    known = donors.select(*keys).distinct().withColumn("_hay", F.lit(True))
    out = missing.withColumn("_t", F.unix_timestamp("momento"))
    out = salted_join(out, answers, [*keys, "_t"], "left")
    out = salted_join(out, known, keys, "left")
    status = F.coalesce("estado", F.when(F.col("_hay"), "fuera_de_6h").otherwise("sin_donante"))
    clean = out.withColumn("estado", status).drop("_t", "_hay")
    good = F.col("estado") == "recuperado"
    for c in ("lat_rec", "lon_rec", "fila_donante", "horas", "dispersion_m", "donantes"):
        clean = clean.withColumn(c, F.when(good, F.col(c)))
    return clean


def _cell_columns() -> list[str]:
    """Every column some level reads."""
    return list(dict.fromkeys(c for _, cols in DONOR_LEVELS for c in cols))


def _text_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cell of each row as text columns; a missing value is the empty text."""
    return df.select(*columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k_{c}") for c in _cell_columns()])


def _cell_levels(asked: DataFrame, donors: DataFrame) -> DataFrame:
    """Cells with their first level that has donors (``nivel``, ``_n``) and the levels whose pools some row uses (``_usados``).

    A cell is one value of every column the levels read, so pools are sums of
    cells and the donors are counted once instead of once per level. The cells of
    a month of a district travel as one row: they are shifts x types x subtypes at
    most, however many donors there are. Wider levels add up those rows.
    """
    names, levels = [f"_k_{c}" for c in _cell_columns()], range(len(DONOR_LEVELS))
    group = [f"_k_{c}" for c in CELL_GROUP]
    given = donors.groupBy(*names).agg(F.count(F.lit(1)).alias("_d")).withColumn("_pide", F.lit(False))
    wanted = asked.select(*names).distinct().withColumn("_d", F.lit(0).cast("long")).withColumn("_pide", F.lit(True))
    inside = {i: [f"_k_{c}" for c in cols if c not in CELL_GROUP] for i, (_, cols) in enumerate(DONOR_LEVELS) if set(CELL_GROUP) <= set(cols)}
    wider = {i: W.partitionBy(*[f"_k_{c}" for c in cols]) for i, (_, cols) in enumerate(DONOR_LEVELS) if i not in inside}
    fields = [c for c in names if c not in group]
    months = spread(given.unionByName(wanted), *group).groupBy(*group).agg(
        F.collect_list(F.when(F.col("_d") > 0, F.struct(*fields, "_d"))).alias("_dan"), F.collect_list(F.when(F.col("_pide"), F.struct(*fields))).alias("_piden"))

    def same(x: Column, y: Column, level: int) -> Column:
        return reduce(lambda out, c: out & (x[c] == y[c]), inside[level], F.lit(True))

    def size(a: Column, level: int) -> Column:
        if level in wider:
            return F.col(f"_n{level}")
        return F.aggregate(F.filter("_dan", lambda x: same(x, a, level)), none, lambda n, x: n + x["_d"])

    def first_level(a: Column) -> Column:
        sizes = F.array(*[F.struct(F.lit(i).alias("nivel"), size(a, i).alias("_n")) for i in levels])
        return F.struct(*[a[c].alias(c) for c in fields], F.get(F.filter(sizes, lambda v: v["_n"] > 0), F.lit(0)).alias("v"))

    def at(level: int) -> Column:
        return F.filter("_piden", lambda a: F.coalesce(a["v"]["nivel"] == level, F.lit(False)))

    def used(x: Column) -> Column:
        marks = [F.col(f"_u{i}") if i in wider else F.exists(f"_en{i}", lambda a: same(x, a, i)) for i in levels]
        return F.struct(*[x[c].alias(c) for c in fields], F.array_compact(F.array(*[F.when(m, i) for i, m in enumerate(marks)])).alias("_usados"))

    none = F.lit(0).cast("long")
    for i, w in wider.items():
        months = months.withColumn(f"_n{i}", F.sum(F.aggregate("_dan", none, lambda n, x: n + x["_d"])).over(w))
    months = months.withColumn("_piden", F.transform("_piden", first_level)).select("*", *[at(i).alias(f"_en{i}") for i in levels])
    for i, w in wider.items():
        months = months.withColumn(f"_u{i}", F.max(F.size(f"_en{i}") > 0).over(w))
    return months.select(*group, F.transform("_dan", used).alias("_dan"), "_piden")


def _pool_key(level: Column) -> Column:
    """Text key of a level's pool."""
    keys = [F.concat_ws("\u0001", *[F.col(f"_k_{c}") for c in cols]) for _, cols in DONOR_LEVELS]
    return F.coalesce(*[F.when(level == i, k) for i, k in enumerate(keys)])


def hot_deck(missing: DataFrame, donors: DataFrame, pick: Column, order: str = "orden", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Donor of the first non-empty level, chosen by ``pick`` modulo its pool.

    Both inputs carry anio, distrito, mes, turno, tipo, subtipo and ``fila``;
    donors add latitud, longitud and the total order column ``order``. Levels
    are found on counted cells, so a donor is repeated only for the pools that
    some missing row uses. Those of more than ``hot_rows`` donors are
    numbered by a distributed rank.
    """
    names = [f"_k_{c}" for c in _cell_columns()]
    known = _text_keys(missing.filter(F.trim(F.coalesce("distrito", F.lit(""))) != "").withColumn("_pick", pick), ["fila", "_pick"])
    by = "fila_donante" if order == "fila" else order
    offered = _text_keys(donors.withColumnRenamed("fila", "fila_donante"), list(dict.fromkeys(["fila_donante", "latitud", "longitud", by])))
    cells = written(_cell_levels(known, offered))
    group = [f"_k_{c}" for c in CELL_GROUP]
    asked = cells.select(*group, F.explode("_piden").alias("_c")).select(*group, "_c.*").filter("v IS NOT NULL").select(*names, "v.*")
    level = salted_join(known, asked, names)
    level = level.select("fila", "nivel", _pool_key(F.col("nivel")).alias("clave"), "_pick", "_n")
    level = written(first_by(level, ["fila"], [F.col("nivel")]).withColumn("_idx", F.pmod(F.col("_pick"), F.col("_n"))))
    used = cells.select(*group, F.explode("_dan").alias("_c")).select(*group, "_c.*").filter("size(_usados) > 0").select(*names, "_usados")
    pool = salted_join(offered, used, names).withColumn("nivel", F.explode("_usados"))
    pool = pool.select("nivel", _pool_key(F.col("nivel")).alias("clave"), "fila_donante", "latitud", "longitud", *([by] if by == order else []))
    ranked = _pool_ranks(pool, level, by, hot_rows).withColumn("_idx", F.col("_r") - 1)
    named = F.element_at(F.array(*[F.lit(n) for n, _ in DONOR_LEVELS]), F.col("nivel") + 1)
    given = level.join(ranked.select("nivel", "clave", "_idx", "fila_donante", "latitud", "longitud"), ["nivel", "clave", "_idx"])
    return given.select("fila", named.alias("nivel_coincidencia"), "fila_donante",
                        F.col("latitud").alias("lat_sim"), F.col("longitud").alias("lon_sim"))


def _pool_ranks(pool: DataFrame, level: DataFrame, by: str, hot_rows: int) -> DataFrame:
    """Donors with their place ``_r`` in the pool; only crowded pools are range-partitioned.

    The crowded pools number at most rows / ``hot_rows``, which bounds their broadcast.
    """
    local = W.partitionBy("nivel", "clave").orderBy(by)
    hot = level.filter(F.col("_n") > hot_rows).select("nivel", "clave").distinct()
    if hot.isEmpty():
        return pool.withColumn("_r", F.row_number().over(local))
    marked = pool.join(F.broadcast(hot.withColumn("_gran", F.lit(True))), ["nivel", "clave"], "left")
    few = marked.filter("_gran IS NULL").drop("_gran")
    many = global_rank(marked.filter("_gran").drop("_gran"), ["nivel", "clave"], [F.col(by)], "_r")
    return few.withColumn("_r", F.row_number().over(local).cast("long")).unionByName(many)


def overlay(rows: DataFrame, recovered: DataFrame, simulated: DataFrame) -> DataFrame:
    """Fill missing places and say where each one comes from; only rows that lack one meet the donors."""
    lacks = F.col("latitud").isNull() | F.col("longitud").isNull()
    joined = (rows.filter(lacks).join(recovered.select("fila", "lat_rec", "lon_rec"), "fila", "left")
              .join(simulated.select("fila", "lat_sim", "lon_sim"), "fila", "left"))
    origin = F.when(F.col("lat_rec").isNotNull(), "MISMA_DENUNCIA").when(F.col("lat_sim").isNotNull(), "SIMULADA").otherwise("SIN_UBI")
    filled = (joined.withColumn("origen_ubi", origin)
              .withColumn("latitud", F.coalesce("lat_rec", "lat_sim")).withColumn("longitud", F.coalesce("lon_rec", "lon_sim"))
              .drop("lat_rec", "lon_rec", "lat_sim", "lon_sim"))
    return filled.unionByName(rows.filter(~lacks).withColumn("origen_ubi", F.lit("OBSERVADA")))


def require_unique(assignments: DataFrame, key: str = "fila") -> DataFrame:
    """Error if an assignment names a row twice."""
    if assignments.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("an assignment repeats a row")
    return assignments


def manifest_matches(incidents: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("id_hecho", "periodo")) -> DataFrame:
    """Incidents per month found in a manifest of simulated places."""
    flags = manifest.select(*keys).distinct().withColumn("_hit", F.lit(1))
    per_key = incidents.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(flags, list(keys), "left").groupBy("periodo").agg(
        F.sum("_n").alias("delitos"), F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(0)).alias("coinciden"))
