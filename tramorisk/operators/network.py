"""Bounded network distances, kernels and batches of shortest paths.

The road graph is two tables. Searches relax every open path of every source
at once; the state is stored after some rounds, so lost executors restart
from the shared folder and plans stay short.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tramorisk.functions.geo import haversine_m
from tramorisk.operators import searches
from tramorisk.operators.ordered import salted_join
from tramorisk.session import settle, table_path, written

# Kernel reach in metres and the search factors.
BANDWIDTHS = (100, 250, 500)
DETOUR_FACTOR = 1.5
ROUNDS_PER_STORE = 6
BROADCAST_BYTES = 64 << 20
#: A road graph of at most this size (by its rows) is sent to tasks whole, which then search for about this many paths each.
GRAPH_BYTES = 128 << 20
TASK_SEARCHES = 512


def adjacency(segments: DataFrame) -> DataFrame:
    """Undirected steps ``desde, hasta, largo``; lengths are at least 1 m."""
    size = F.greatest(F.col("longitud_m"), F.lit(1.0)).alias("largo")
    there = segments.select(F.col("u").alias("desde"), F.col("v").alias("hasta"), size)
    back = segments.filter("u <> v").select(F.col("v").alias("desde"), F.col("u").alias("hasta"), size)
    return there.unionByName(back).groupBy("desde", "hasta").agg(F.min("largo").alias("largo"))


def incident_segments(segments: DataFrame) -> DataFrame:
    """Node, segment and half length of every segment end."""
    half = (F.greatest(F.col("longitud_m"), F.lit(1.0)) / 2.0).alias("mitad")
    return segments.select("tramo_id", half, F.explode(F.array_distinct(F.array("u", "v"))).alias("nodo"))


def _sized(stored: DataFrame, fixed_bytes: int = 48, lists: Sequence[str] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Stored table with a broadcast hint if its measured size is within ``limit`` bytes.

    A larger table joins by shuffle, with AQE splitting its crowded nodes.
    """
    entries = [F.sum(F.size(c)) for c in lists]
    size = stored.agg(F.count(F.lit(1)) * fixed_bytes + sum((F.coalesce(e, F.lit(0)) * 40 for e in entries), F.lit(0))).first()[0]
    return F.broadcast(stored) if size <= limit else stored


def _spread(state: DataFrame, *keys: str) -> DataFrame:
    """Cluster a search by its keys over a fixed number of tasks.

    The first frontier is tiny and grows a thousandfold, so the number must
    not follow its size.
    """
    spark = state.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return state.repartition(tasks, *keys)


def midpoint_distances(segments: DataFrame, active: DataFrame, limit: float) -> DataFrame:
    """Network distance between midpoints, strictly below ``limit``.

    ``active`` lists the source segments; a source is at distance 0 of itself.
    Every step table holds a zero step from each node to itself, so a round is
    one join and one minimum. Rows stay clustered by source: with a small step
    table a round moves no data.
    """
    stay = incident_segments(segments).select(F.col("nodo").alias("desde"), F.col("nodo").alias("hasta"), F.lit(0.0).alias("largo")).distinct()
    steps = _sized(settle(adjacency(segments).filter("desde <> hasta").unionByName(stay)))
    ends = incident_segments(segments)
    start = ends.join(active.select("tramo_id").distinct(), "tramo_id", "left_semi")
    state = start.filter(F.col("mitad") < limit).select(
        F.col("tramo_id").alias("origen"), "nodo", F.col("mitad").alias("dist"), F.lit(True).alias("nuevo"))
    while True:
        state = _spread(state, "origen")
        for _ in range(ROUNDS_PER_STORE):
            state = _relax_distance(state, steps, limit)
        state = settle(state)
        if state.filter("nuevo").limit(1).count() == 0:
            break
    reached = state.select("origen", "nodo", "dist").join(ends, "nodo")
    reached = reached.select("origen", F.col("tramo_id").alias("destino"), (F.col("dist") + F.col("mitad")).alias("dist_m"))
    own = active.select(F.col("tramo_id").alias("origen")).distinct().select("origen", F.col("origen").alias("destino"), F.lit(0.0).alias("dist_m"))
    return reached.filter(F.col("dist_m") < limit).unionByName(own).groupBy("origen", "destino").agg(F.min("dist_m").alias("dist_m"))


def _relax_distance(state: DataFrame, steps: DataFrame, limit: float) -> DataFrame:
    stays = F.col("desde") == F.col("hasta")
    moved = state.join(steps, (F.col("nodo") == F.col("desde")) & (F.col("nuevo") | stays))
    moved = moved.select("origen", F.col("hasta").alias("nodo"), (F.col("dist") + F.col("largo")).alias("dist"),
                         F.when(stays, F.col("dist")).alias("antes")).filter(F.col("dist") < limit)
    best = moved.groupBy("origen", "nodo").agg(F.min("dist").alias("dist"), F.min("antes").alias("antes"))
    return best.select("origen", "nodo", "dist", (F.col("antes").isNull() | (F.col("dist") < F.col("antes"))).alias("nuevo"))


def triangular_kernel(distances: DataFrame, segments: DataFrame, bandwidth: float) -> DataFrame:
    """Kernel 1 - d/h, scaled so each source spreads 100 over its road length."""
    lengths = segments.select(F.col("tramo_id").alias("destino"), F.greatest(F.col("longitud_m"), F.lit(1.0)).alias("largo"))
    near = distances.filter(F.col("dist_m") < bandwidth).withColumn("k", F.lit(1.0) - F.col("dist_m") / float(bandwidth))
    near = near.join(lengths, "destino")
    norm = F.sum(F.col("k") * F.col("largo")).over(W.partitionBy("origen"))
    return near.select("origen", "destino", "dist_m", (F.col("k") * 100.0 / F.greatest(norm, F.lit(1e-9))).alias("w"))


def plain_kernels(distances: DataFrame, radius: float, sigma: float = 100.0) -> DataFrame:
    """Binary and Gaussian weights strictly inside ``radius``."""
    ratio = F.col("dist_m") / sigma
    return distances.filter(F.col("dist_m") < radius).select(
        "origen", "destino", "dist_m", F.lit(1.0).alias("w_bin"), F.exp(ratio * ratio * -0.5).alias("w_gauss"))


def project(cube: DataFrame, kernel: DataFrame, value: str, keys: Sequence[str] = ("mes_idx", "turno_idx"),
            name: str = "densidad") -> DataFrame:
    """Spread a measure from its segment to the segments the kernel reaches."""
    source = cube.filter(F.col(value) != 0).select(F.col("tramo_id").alias("origen"), *keys, value)
    moved = salted_join(source, kernel.select("origen", "destino", "w"), ["origen"])
    return moved.groupBy(F.col("destino").alias("tramo_id"), *keys).agg(F.sum(F.col("w") * F.col(value)).alias(name))


def kernel_panel(cube: DataFrame, kernels: DataFrame, counts: Sequence[str], weight: str = "peso") -> DataFrame:
    """Monthly panel on the network: Gaussian severity and binary counts."""
    from tramorisk.functions.calendar import SHIFTS

    monthly = cube.groupBy("tramo_id", "mes_idx").agg(
        *[F.sum(c).alias(c) for c in (*counts, weight)],
        *[F.sum(F.when(F.col("turno_idx") == i, F.col("n")).otherwise(0)).alias(s) for i, s in enumerate(SHIFTS)])
    moved = salted_join(monthly.withColumnRenamed("tramo_id", "origen"), kernels, ["origen"])
    return moved.groupBy(F.col("destino").alias("tramo_id"), "mes_idx").agg(
        *[F.sum(F.col(c) * F.col("w_bin")).alias(c) for c in (*counts, *SHIFTS)],
        F.sum(F.col(weight) * F.col("w_gauss")).alias(weight))


# ---------------------------------------------------------------- routes

def directed_edges(segments: DataFrame, two_way: bool = True) -> DataFrame:
    """Directed edges ``desde, hasta`` of each segment with its columns."""
    there = segments.withColumn("desde", F.col("u")).withColumn("hasta", F.col("v"))
    if not two_way:
        return there
    back = segments.filter("u <> v").withColumn("desde", F.col("v")).withColumn("hasta", F.col("u"))
    return there.unionByName(back)


def _moves(edges: DataFrame, costs: dict[str, Column], reads: Sequence[str]) -> DataFrame:
    return edges.select("desde", "hasta", "tramo_id", F.col("riesgo").alias("_riesgo"), F.col("largo").cast("double").alias("_largo"),
                        F.array(*[c.cast("double") for c in costs.values()]).alias("_costos"), *reads)


def shortest_labels(requests: DataFrame, edges: DataFrame, costs: dict[str, Column], blocked: Column | None = None, reads: Sequence[str] = ()) -> DataFrame:
    """Label of every node a search reaches: ``ruta``, ``variante``, ``nodo``, ``costo``, ``expo``, ``largo`` and the step before (``previo``, ``tramo_id``).

    ``requests``: ruta, origen, destino (and whatever ``blocked`` reads).
    ``edges``: desde, hasta, tramo_id, largo, riesgo and the columns in
    ``reads``; ``costs`` are expressions over them and not negative. A step that
    ``blocked`` holds for is closed; its way back, or every step to its node, must
    be closed too. Labels order by cost, exposure, length and then by the step
    before, which therefore always belongs to a final label. Labels dearer than
    the best arrival of their request and variant are dropped. Rows are
    clustered by request and variant, so a round moves no data while the
    step table is small.

    A search carries its front only: a label cheaper than every open one of its
    search is final, and leaves for good once no label that is not final can step to
    it. That needs every step to have a way back; where one lacks it, labels
    stay until their search ends.
    """
    names = list(costs)
    carried = [c for c in requests.columns if c not in ("ruta", "origen", "destino")]
    moves = _moves(edges, costs, reads)
    nodes = edges.select(F.explode(F.array("desde", "hasta")).alias("n")).distinct()
    stay = nodes.select(F.col("n").alias("desde"), F.col("n").alias("hasta"))
    steps = written(moves.unionByName(stay, True))
    pairs = steps.select("desde", "hasta")
    two_way = pairs.join(pairs.select(F.col("desde").alias("hasta"), F.col("hasta").alias("desde")), ["desde", "hasta"], "left_anti").isEmpty()
    lists = [f.name for f in steps.schema.fields if f.name in reads and f.dataType.typeName() == "array"]
    steps = _sized(steps, 64 + 8 * (len(names) + len(reads)), lists)
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    start = F.struct(F.lit(0.0).alias("costo"), F.lit(0.0).alias("expo"), F.lit(0.0).alias("largo"), F.lit(None).cast(edges.schema["desde"].dataType).alias("previo"),
                     F.lit(None).cast("string").alias("tramo_id"))
    state = requests.withColumn("_k", F.explode(kinds)).select(
        "ruta", "destino", *carried, F.col("_k.i").alias("vi"), F.col("_k.n").alias("variante"), F.col("origen").alias("nodo"), start.alias("mejor"), F.lit(True).alias("nuevo"),
        F.lit(None).cast("double").alias("_tope"))
    path, stage = table_path(state.sparkSession), 0
    while True:
        state = _spread(state, "ruta", "vi")
        for _ in range(ROUNDS_PER_STORE):
            state = _relax_labels(state, steps, carried, blocked)
        _final_labels(state, steps, carried, two_way).write.parquet(f"{path}/etapa={stage}")
        schema = state.schema.add("fuera", "boolean")
        state = state.sparkSession.read.schema(schema).parquet(f"{path}/etapa={stage}").filter(~F.col("fuera")).drop("fuera")
        if state.isEmpty():
            break
        stage += 1
    labels = state.sparkSession.read.schema(schema).parquet(path).filter("fuera")
    return labels.select("ruta", "variante", *carried, "destino", "nodo", "mejor.*")


def _relax_labels(state: DataFrame, steps: DataFrame, carried: Sequence[str], blocked: Column | None) -> DataFrame:
    stays = F.col("tramo_id").isNull()
    opens = F.col("nuevo") & (F.col("nodo") != F.col("destino"))
    moved = state.join(steps, (F.col("nodo") == F.col("desde")) & (opens | stays))
    if blocked is not None:
        moved = moved.filter(stays | ~blocked)
    grown = F.struct((F.col("mejor.costo") + F.get("_costos", F.col("vi"))).alias("costo"), (F.col("mejor.expo") + F.col("_riesgo") * F.col("_largo")).alias("expo"),
                     (F.col("mejor.largo") + F.col("_largo")).alias("largo"), F.col("nodo").alias("previo"), F.col("tramo_id"))
    moved = moved.select("ruta", "destino", *carried, "vi", "variante", "_tope", F.col("hasta").alias("nodo"), F.when(stays, F.col("mejor")).otherwise(grown).alias("mejor"),
                         stays.alias("_queda")).filter(F.col("_queda") | F.col("_tope").isNull() | (F.col("mejor.costo") <= F.col("_tope")))
    best = moved.groupBy("ruta", "vi", "nodo").agg(
        F.min("mejor").alias("mejor"), F.min(F.when(F.col("_queda"), F.col("mejor"))).alias("_antes"),
        *[F.first(c).alias(c) for c in ("destino", "variante", "_tope", *carried)])
    size = lambda c: F.struct(f"{c}.costo", f"{c}.expo", f"{c}.largo")
    return best.select("ruta", "destino", *carried, "vi", "variante", "nodo", "mejor", (F.col("_antes").isNull() | (size("mejor") < size("_antes"))).alias("nuevo"), "_tope")


def _final_labels(state: DataFrame, steps: DataFrame, carried: Sequence[str], two_way: bool) -> DataFrame:
    """The labels within the best arrival so far (``_tope``); ``fuera`` are final and next to final ones only, or of a search that has ended."""
    search, cost = W.partitionBy("ruta", "vi"), F.col("mejor.costo")
    arrival = F.min(F.when(F.col("nodo") == F.col("destino"), cost)).over(search)
    cheapest = F.min(F.when(F.col("nuevo") & (F.col("nodo") != F.col("destino")), cost)).over(search)
    known = state.withColumn("_tope", arrival).withColumn("_piso", cheapest).filter(F.col("_tope").isNull() | (cost <= F.col("_tope")))
    ended = F.col("_piso").isNull() | F.coalesce(F.col("_piso") > F.col("_tope"), F.lit(False))
    opens = F.col("nuevo") & (F.col("nodo") != F.col("destino"))
    known = known.withColumn("nuevo", opens).withColumn("_fijo", ended | (F.lit(two_way) & ~opens & (cost < F.col("_piso")))).drop("_piso")
    # Labels that are not final mark the nodes they can step to, and their own.
    stays = F.col("_paso").isNull()
    marks = steps.select("desde", "hasta", F.col("tramo_id").alias("_paso"))
    rest = [c for c in state.columns if c not in ("ruta", "vi", "nodo")]
    moved = known.join(marks, (F.col("nodo") == F.col("desde")) & (stays | ~F.col("_fijo"))).select(
        "ruta", "vi", F.col("hasta").alias("nodo"), F.when(stays, F.struct(*rest)).alias("_fila"), (~F.col("_fijo")).alias("_toca"))
    kept = moved.groupBy("ruta", "vi", "nodo").agg(F.max("_toca").alias("_toca"), F.first("_fila", ignorenulls=True).alias("_fila")).filter("_fila IS NOT NULL")
    at = {c: F.col(f"_fila.{c}").alias(c) for c in rest}
    return kept.select(*[at.get(c, F.col(c)) for c in state.columns], (~F.col("_toca")).alias("fuera"))


def _walked(table: pa.Table) -> pa.Table:
    """Steps of one path, from its destination back over the steps before."""
    nodes, before = table.column("nodo").to_pylist(), table.column("previo").to_pylist()
    row_of, at, rows = {n: i for i, n in enumerate(nodes)}, table.column("destino")[0].as_py(), []
    while at in row_of and before[row_of[at]] is not None:
        rows.append(row_of[at])
        at = before[rows[-1]]
    found = table.select(["ruta", "variante", "tramo_id"]).take(pa.array(rows, pa.int64()))
    return found.append_column("atras", pa.array(range(len(rows)), pa.int64()))


def trace_back(labels: DataFrame) -> DataFrame:
    """Steps of the path to each request's destination, from the step-before table: ``ruta``, ``variante``, ``atras`` (0 is the last step), ``tramo_id``.

    The labels of one search meet once, and its path is walked there.
    """
    kinds = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
    arrived = labels.select("ruta", "variante", "destino", "nodo", "previo", "tramo_id")
    return arrived.groupBy("ruta", "variante").applyInArrow(_walked, f"ruta {kinds['ruta']}, variante {kinds['variante']}, tramo_id string, atras long").select(
        "ruta", "variante", "atras", "tramo_id")


def shortest_paths(requests: DataFrame, edges: DataFrame, costs: dict[str, Column], blocked: Column | None = None, reads: Sequence[str] = ()) -> DataFrame:
    """Cheapest path of every request under every named cost, with its segments in order; see ``shortest_labels``.

    With a measured road graph of at most ``GRAPH_BYTES`` and more searches than
    cores, whole searches run inside tasks; else all relax together.
    """
    inside = _paths_in_tasks(requests, edges, costs, blocked, reads)
    if inside is not None:
        return inside
    carried = [c for c in requests.columns if c not in ("ruta", "origen", "destino")]
    labels = shortest_labels(requests, edges, costs, blocked, reads)
    steps = trace_back(labels).groupBy("ruta", "variante").agg(F.array_sort(F.collect_list(F.struct((-F.col("atras")).alias("o"), "tramo_id"))).alias("_t"))
    ends = labels.filter("nodo = destino").join(steps, ["ruta", "variante"], "left")
    return ends.select("ruta", "variante", *carried, "costo", "expo", "largo", F.coalesce(F.col("_t.tramo_id"), F.array().cast("array<string>")).alias("tramos"))


def _paths_in_tasks(requests: DataFrame, edges: DataFrame, costs: dict[str, Column], blocked: Column | None, reads: Sequence[str]) -> DataFrame | None:
    """``shortest_paths`` with every search inside one task, or None where the graph is too large, the searches are few or a step has no usable cost.

    ``blocked`` is decided here, for every request (or every set of what it carries,
    if it asks for the variant) and every distinct set of ``reads``; tasks get the sets that are open.
    """
    spark, names = requests.sparkSession, list(costs)
    carried = [c for c in requests.columns if c not in ("ruta", "origen", "destino")]
    if requests.count() * len(names) <= spark.sparkContext.defaultParallelism:
        return None
    steps = written(_moves(edges, costs, reads).filter("desde IS NOT NULL AND hasta IS NOT NULL"))
    sums = F.concat(F.array("_riesgo", "_largo"), "_costos")
    usable = F.col("tramo_id").isNotNull() & F.forall(sums, lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall("_costos", lambda v: v >= 0)
    rows, bad = steps.agg(F.count(F.lit(1)), F.count(F.when(~usable, 1))).first()
    if bad or not rows or rows * (96 + 8 * len(names)) > GRAPH_BYTES:
        return None
    known = [f for f in requests.schema.fields if f.name not in ("origen", "destino")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-requests.count() * len(names) // TASK_SEARCHES))
    asked = requests.repartition(tasks, "ruta").dropDuplicates(["ruta"])
    kinds = F.array(*[F.lit(i) for i in range(len(names))])
    if blocked is None:
        steps = steps.withColumn("_sitio", F.lit(0))
        asked = asked.withColumn("_k", kinds).withColumn("_abre", F.lit(None).cast("array<int>"))
    else:
        sites = written(steps.select(*reads).distinct().coalesce(1).withColumn("_sitio", F.monotonically_increasing_id().cast("int")))
        same = [F.col(f"_s.{c}").eqNullSafe(F.col(f"_e.{c}")) for c in reads]
        steps = steps.alias("_e").join(F.broadcast(sites.alias("_s")), same).select("_e.*", "_s._sitio")
        opened = F.collect_list("_sitio").alias("_abre")
        if "variante" in str(blocked):
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
            sets = requests.select(*carried).distinct().withColumn("_k", each).select(*carried, F.col("_k.n").alias("variante"), F.array("_k.i").alias("_k"))
            sets = sets.join(F.broadcast(sites), ~blocked, "left").groupBy(*carried, "_k").agg(opened)
            asked = asked.alias("_a").join(sets.alias("_b"), [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in carried]).select("_a.*", "_b._k", "_b._abre")
            asked = asked.repartition(tasks, "ruta", "_k")
        else:
            # The rows of a request stay in its task, so nothing is shuffled.
            first = [F.first(c).alias(c) for c in asked.columns if c != "ruta"]
            asked = asked.join(F.broadcast(sites), ~blocked, "left").groupBy("ruta").agg(*first, opened).withColumn("_k", kinds)
    graph = searches.Graph.of(steps.select("desde", "hasta", "tramo_id", "_riesgo", "_largo", "_costos", "_sitio").toArrow())
    out = T.StructType([*known, *T.StructType.fromDDL("variante string, costo double, expo double, largo double, tramos array<string>").fields])
    found = asked.select(*[f.name for f in known], "origen", "destino", "_k", "_abre").mapInArrow(partial(searches.searched, graph, names), out)
    return found.select("ruta", "variante", *carried, "costo", "expo", "largo", "tramos")


def route_variants(requests: DataFrame, edges: DataFrame, costs: dict[str, Column], fast: str, factor: float = DETOUR_FACTOR) -> DataFrame:
    """The fastest path of each request, and every other variant inside the ellipse that its detour budget leaves.

    ``requests`` carries o_lat, o_lon, d_lat, d_lon and acceso_m; ``edges`` the
    place (h_lat, h_lon) of the node a step leads to. A node is open if the ways
    to both ends add up to no more than the budget of ``detour_budget``.
    """
    quick = written(shortest_paths(requests.select("ruta", "origen", "destino"), edges, {fast: costs[fast]}))
    asked = requests.join(quick.select("ruta", "largo"), "ruta").withColumn("tope", detour_budget(factor)).drop("largo", "acceso_m", "ox", "oy", "dx", "dy")
    way = haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("h_lat"), F.col("h_lon")) + haversine_m(F.col("h_lat"), F.col("h_lon"), F.col("d_lat"), F.col("d_lon"))
    rest = shortest_paths(asked, edges, {k: v for k, v in costs.items() if k != fast}, way > F.col("tope"), ("h_lat", "h_lon"))
    return quick.unionByName(rest.select(*quick.columns))


def detour_budget(factor: float = DETOUR_FACTOR) -> Column:
    """Metres a path may have between the ends, by its shortest length and the access to the network."""
    return (F.col("largo") + F.col("acceso_m")) * factor - F.col("acceso_m") + 1.0


def candidate_nodes(requests: DataFrame, nodes: DataFrame, shortest: DataFrame, factor: float = DETOUR_FACTOR) -> DataFrame:
    """Nodes a path within the detour budget may visit, per request.

    ``requests`` carries the metric points ox, oy, dx, dy of both ends and
    access_m; the search box bounds the pairs, the ellipse decides.
    """
    asked = requests.join(shortest.select("ruta", "largo"), "ruta").withColumn("tope", detour_budget(factor))
    size = 1000.0
    mid_x, mid_y, reach = (F.col("ox") + F.col("dx")) / 2, (F.col("oy") + F.col("dy")) / 2, F.col("tope") / 2 + 50.0
    cells = F.flatten(F.transform(F.sequence(F.floor((mid_x - reach) / size), F.floor((mid_x + reach) / size)), lambda i: F.transform(
        F.sequence(F.floor((mid_y - reach) / size), F.floor((mid_y + reach) / size)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    asked = asked.withColumn("_c", F.explode(cells)).withColumn("_cx", F.col("_c.i")).withColumn("_cy", F.col("_c.j"))
    spots = nodes.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    pairs = salted_join(spots, asked.select("ruta", "o_lat", "o_lon", "d_lat", "d_lon", "tope", "_cx", "_cy"), ["_cx", "_cy"])
    way = haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon")) + haversine_m(
        F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    return pairs.filter(way <= F.col("tope")).select("ruta", "nodo")


def explode_route(routes: DataFrame) -> DataFrame:
    """One row per step of each route, in order."""
    kept = [c for c in routes.columns if c != "tramos"]
    return routes.select(*kept, F.posexplode("tramos").alias("orden", "tramo_id"))


def route_totals(steps: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance, time, exposure, levels and zone metres of each route.

    ``edges``: tramo_id, largo, riesgo, nivel, rojo_m, naranja_m.
    """
    full = steps.join(edges.select("tramo_id", "largo", "riesgo", "nivel", "rojo_m", "naranja_m"), "tramo_id")
    d, r = F.round("largo", 2), F.round("riesgo", 6)
    at = lambda name: F.sum(F.when(F.col("nivel") == name, d).otherwise(0.0)).alias(f"metros_{name}")
    out = full.groupBy(*keys).agg(
        F.sum(d).alias("metros"), F.sum(r.cast("decimal(9,6)") * d.cast("decimal(18,2)")).cast("double").alias("_rm"), at("bajo"), at("medio"), at("alto"),
        F.count(F.when(F.col("nivel") == "alto", 1)).alias("tramos_altos"), F.count(F.lit(1)).alias("pasos"),
        F.sum(F.round("rojo_m", 3)).alias("rojo_m"), F.sum(F.round("naranja_m", 3)).alias("naranja_m"))
    return out.select(*keys, F.round(F.col("metros") / 1000, 3).alias("distancia_km"),
                      F.round(F.col("metros") / (25 * 1000 / 60), 1).alias("tiempo_min"),
                      F.round(F.col("_rm") / 1000, 6).alias("riesgo_total"), F.round(F.col("_rm") / F.col("metros"), 6).alias("riesgo_promedio"),
                      *[F.round(f"metros_{n}", 2).alias(f"metros_{n}") for n in ("bajo", "medio", "alto")],
                      "tramos_altos", "pasos", F.round("rojo_m", 3).alias("rojo_m"), F.round("naranja_m", 3).alias("naranja_m"))


def route_signature(tramos: Column) -> Column:
    return F.md5(F.array_join(tramos, ">"))


def distinct_routes(routes: DataFrame) -> DataFrame:
    """First variant of each different path of a request."""
    from tramorisk.operators.ordered import first_by

    return first_by(routes.withColumn("firma", route_signature(F.col("tramos"))), ["ruta", "firma"], [F.col("variante")])


def shared_metres(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments and metres two routes of a request have in common."""
    a, b = explode_route(left).select("ruta", "tramo_id"), explode_route(right).select("ruta", "tramo_id")
    both = a.join(b.distinct(), ["ruta", "tramo_id"], "left_semi").join(edges.select("tramo_id", "largo"), "tramo_id")
    return both.groupBy("ruta").agg(F.count(F.lit(1)).alias("tramos_compartidos"), F.round(F.sum(F.round("largo", 2)), 2).alias("metros_compartidos"))


def continuity_breaks(routes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps that do not touch the step before, per route."""
    steps = explode_route(routes).join(edges.select("tramo_id", "u", "v").distinct(), "tramo_id")
    w = W.partitionBy(*keys).orderBy("orden")
    pu, pv = F.lag("u").over(w), F.lag("v").over(w)
    broken = pu.isNotNull() & (F.col("u") != pu) & (F.col("u") != pv) & (F.col("v") != pu) & (F.col("v") != pv)
    return steps.withColumn("_b", broken.cast("int")).groupBy(*keys).agg(F.sum("_b").alias("cortes"))


def avoidable_metres(steps: DataFrame, hits: DataFrame, exempt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Red and orange metres of each route in zones that do not hold one of its ends.

    ``steps``: keys (with ruta) and tramo_id; ``hits``: tramo_id, zona, color,
    metros; ``exempt``: ruta, zona.
    """
    inside = steps.join(hits.select("tramo_id", "zona", "color", "metros"), "tramo_id").join(exempt.select("ruta", "zona").distinct(), ["ruta", "zona"], "left_anti")
    of = lambda colour, name: F.round(F.sum(F.when(F.col("color") == colour, F.col("metros")).otherwise(0.0)), 3).alias(name)
    found = inside.groupBy(*keys).agg(of("rojo", "rojo_ev"), of("naranja", "naranja_ev"))
    return steps.select(*keys).distinct().join(found, list(keys), "left").fillna(0.0, ["rojo_ev", "naranja_ev"])


def choose_route(candidates: DataFrame, reference: DataFrame, with_field: bool) -> DataFrame:
    """Chosen candidate of each request, or its reference route.

    Candidates and reference carry firma, distancia_km, riesgo_total,
    metros_alto, rojo_m, naranja_m, rojo_ev, naranja_ev and variante.
    """
    from tramorisk.functions.risk import risk_reduction
    from tramorisk.operators.ordered import first_by

    base = reference.select("ruta", F.col("distancia_km").alias("_bk"), F.col("riesgo_total").alias("_br"), F.col("firma").alias("_bf"))
    rows = candidates.join(base, "ruta").withColumn("reduccion", risk_reduction(F.col("_br"), F.col("riesgo_total")))
    far = F.col("distancia_km") > F.col("_bk") * DETOUR_FACTOR + 1e-9
    if with_field:
        reason = F.when(far, "desvio_excesivo")
        order = [F.col("rojo_ev"), F.col("naranja_ev"), F.col("rojo_m"), F.col("naranja_m"), F.col("riesgo_total"), F.col("distancia_km")]
    else:
        reason = F.when(far, "desvio_excesivo").when(F.col("firma") == F.col("_bf"), "mismo_recorrido").when(
            F.col("reduccion") < 0.5, "mejora_insuficiente")
        order = [F.col("metros_alto"), -F.col("reduccion"), F.col("distancia_km")]
    judged = rows.withColumn("rechazo", reason)
    rejected = judged.groupBy("ruta").agg(*[F.count(F.when(F.col("rechazo") == r, 1)).alias(r)
                                            for r in ("desvio_excesivo", "mismo_recorrido", "mejora_insuficiente")])
    best = first_by(judged.filter(F.col("rechazo").isNull()).drop("rechazo", "_bk", "_br", "_bf"), ["ruta"], [*order, F.col("variante")])
    chosen = base.select("ruta").join(best, "ruta", "left").join(rejected, "ruta", "left")
    none = F.col("variante").isNull()
    return chosen.join(base, "ruta").select(
        "ruta", F.coalesce("variante", F.lit("recorrido_base")).alias("variante"),
        F.when(none, F.col("_bk")).otherwise(F.col("distancia_km")).alias("distancia_km"),
        F.when(none, F.col("_br")).otherwise(F.col("riesgo_total")).alias("riesgo_total"),
        F.when(none | (F.col("firma") == F.col("_bf")), 0.0).otherwise(F.col("reduccion")).alias("reduccion"),
        (none | (F.col("firma") == F.col("_bf"))).cast("int").alias("mismo_recorrido_final"),
        *[F.coalesce(r, F.lit(0)).alias(f"rechazo_{r}") for r in ("desvio_excesivo", "mismo_recorrido", "mejora_insuficiente")])


# The ladder's edge sets: excluded colours, with and without clearance.
LADDER = {"libre": "", "sin_rojo": "R", "sin_naranja": "O", "sin_ambos": "RO",
          "sin_rojo_margen": "Rr", "sin_naranja_margen": "Oo", "sin_ambos_margen": "ROro"}


ZONES = ("zonas_rojo", "zonas_naranja", "zonas_rojo_margen", "zonas_naranja_margen")


def ladder_block() -> Column:
    """Edge closed for a request: a non-exempt zone of an excluded colour."""
    touches = lambda zones: F.size(F.array_except(zones, F.col("exentas"))) > 0
    closed = F.lit(False)
    for flag, column in zip("ROro", ZONES, strict=True):
        kinds = [k for k, flags in LADDER.items() if flag in flags]
        closed = closed | (F.col("variante").isin(*kinds) & touches(F.col(column)))
    return closed


def ladder_policy(paths: DataFrame, fast_km: str = "libre", factor: float = DETOUR_FACTOR) -> DataFrame:
    """Which colours each request can avoid within the detour limit.

    ``paths``: ruta, variante, distancia_km. A missing variant has no path.
    """
    wide = paths.groupBy("ruta").pivot("variante", list(LADDER)).agg(F.first("distancia_km"))
    limit = F.col(fast_km) * factor + 1e-9
    ok = lambda c: F.coalesce(c <= limit, F.lit(False))
    state = lambda c: F.when(c.isNull(), "no_viable_path").when(c <= limit, "avoided").otherwise("detour_limit")
    red_ok = ok(F.col("sin_rojo"))
    second = F.when(red_ok, F.col("sin_ambos")).otherwise(F.col("sin_naranja"))
    orange_ok = ok(second)
    active = (F.when(red_ok & orange_ok, "sin_ambos").when(red_ok, "sin_rojo").when(orange_ok, "sin_naranja").otherwise("libre"))
    margin = (F.when(red_ok & orange_ok, F.col("sin_ambos_margen")).when(red_ok, F.col("sin_rojo_margen")).when(orange_ok, F.col("sin_naranja_margen")))
    cleared = ok(margin)
    return wide.select("ruta", F.col(fast_km).alias("distancia_libre_km"), state(F.col("sin_rojo")).alias("rojo"), state(second).alias("naranja"),
                       cleared.cast("int").alias("margen_aplicado"),
                       F.when(cleared, F.concat(active, F.lit("_margen"))).otherwise(active).alias("variante_activa"),
                       F.when(cleared, margin).when(red_ok & orange_ok, F.col("sin_ambos")).when(red_ok, F.col("sin_rojo")).when(
                           orange_ok, F.col("sin_naranja")).otherwise(F.col(fast_km)).alias("distancia_activa_km"))
