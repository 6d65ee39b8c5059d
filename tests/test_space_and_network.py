import heapq
import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tramorisk.functions import geo
from tramorisk.operators import impute, network as net, spatial, surface


def _piece_distance(x, y, p):
    (x1, y1), (x2, y2) = p
    dx, dy = x2 - x1, y2 - y1
    t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def _lines(spark, lines):
    rows = [(k, [dict(x1=a[0], y1=a[1], x2=b[0], y2=b[1]) for a, b in zip(v, v[1:])]) for k, v in lines.items()]
    return spark.createDataFrame(rows, "tramo_id string, piezas array<struct<x1:double,y1:double,x2:double,y2:double>>")


def test_buffer_join_equals_brute_force(spark):
    rng = random.Random(5)
    lines = {f"t{i}": [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(rng.choice([2, 3, 6]))] for i in range(30)}
    points = [(i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(120)] + [(200 + i, 450.0, 450.0) for i in range(60)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r["id"], r["tramo_id"]): r["dist_m"] for r in spatial.near_polylines(df, _lines(spark, lines), 120.0).collect()}
    want = {}
    for i, x, y in points:
        for k, v in lines.items():
            d = min(_piece_distance(x, y, p) for p in zip(v, v[1:]))
            if d <= 120:
                want[i, k] = d
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_neighbors_equal_brute_force_with_a_crowded_spot(spark):
    rng = random.Random(8)
    pts = [(f"p{i:03d}", rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(60)] + [(f"q{i:03d}", 77.0, 77.0) for i in range(70)]
    got = {}
    for r in spatial.nearest_neighbors(spark.createDataFrame(pts, "tramo_id string, x double, y double"), 5).collect():
        got.setdefault(r["tramo_id"], {})[r["puesto"]] = r["vecino_id"]
    for a, x, y in pts:
        best = sorted((math.hypot(x - u, y - v), b) for b, u, v in pts if b != a)[:5]
        assert [got[a][k] for k in range(1, 6)] == [b for _, b in best]


def test_utm_known_point(spark):
    # 77.03 W, 12.05 S lies about 221 km west of the central meridian of zone 18
    e, n = spark.range(1).select(*geo.utm_xy(F.lit(-75.0), F.lit(-12.0))).first()
    assert e == pytest.approx(500_000.0) and n == pytest.approx(10_000_000 - 0.9996 * 1_326_845.0, rel=2e-3)
    a = spark.range(1).select(*geo.utm_xy(F.lit(-77.03), F.lit(-12.05))).first()
    b = spark.range(1).select(*geo.utm_xy(F.lit(-77.03), F.lit(-12.05 + 1e-4))).first()
    assert math.hypot(a[0] - b[0], a[1] - b[1]) == pytest.approx(11.062, abs=0.01)


def test_chord_equals_dense_sampling(spark):
    piece = dict(x1=0.0, y1=0.0, x2=300.0, y2=120.0)
    df = spark.createDataFrame([(piece, 140.0, 30.0, 80.0), (piece, 0.0, 900.0, 10.0), (piece, 300.0, 120.0, 5000.0)], "p struct<x1:double,y1:double,x2:double,y2:double>, cx double, cy double, r double")
    for row in df.withColumn("m", geo.chord_m(F.col("p"), F.col("cx"), F.col("cy"), F.col("r"))).collect():
        inside = sum(math.hypot(300 * f - row.cx, 120 * f - row.cy) <= row.r for f in ((i + 0.5) / 20000 for i in range(20000)))
        assert row.m == pytest.approx(inside / 20000 * math.hypot(300, 120), abs=0.1)


def _grid(n=5):
    rng, edges = random.Random(2), []
    for i in range(n):
        for j in range(n):
            if j + 1 < n:
                edges.append((f"h{i}{j}", i * n + j, i * n + j + 1, float(rng.randint(40, 160)), rng.random()))
            if i + 1 < n:
                edges.append((f"v{i}{j}", i * n + j, (i + 1) * n + j, float(rng.randint(40, 160)), rng.random()))
    return edges


def _dijkstra(adj, starts):
    dist, heap = {}, [(d, n) for n, d in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n] = d
        for m, w in adj.get(n, ()):
            heapq.heappush(heap, (d + w, m))
    return dist


def test_midpoint_distances_equal_dijkstra(spark):
    edges = _grid()
    seg = spark.createDataFrame([e[:4] for e in edges], "tramo_id string, u int, v int, longitud_m double")
    got = {(r["origen"], r["destino"]): r["dist_m"] for r in net.midpoint_distances(seg, seg.filter("tramo_id LIKE 'h%'"), 300.0).collect()}
    adj = {}
    for _, u, v, w, _ in edges:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    want = {}
    for t, u, v, w, _ in edges:
        if t[0] == "h":
            d = _dijkstra(adj, {u: w / 2, v: w / 2})
            for t2, u2, v2, w2, _ in edges:
                best = 0.0 if t2 == t else min(d[u2], d[v2]) + w2 / 2
                if best < 300:
                    want[t, t2] = best
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_shortest_paths_equal_dijkstra(spark):
    edges = _grid()
    seg = spark.createDataFrame(edges, "tramo_id string, u int, v int, largo double, riesgo double")
    req = spark.createDataFrame([("a", 0, 24), ("b", 20, 4), ("c", 12, 0)], "ruta string, origen int, destino int")
    cost = {"rapida": F.col("largo"), "segura": F.col("largo") * (F.lit(1.0) + F.col("riesgo") * 10)}
    got = {(r["ruta"], r["variante"]): r for r in net.shortest_paths(req, net.directed_edges(seg), cost).collect()}
    for name, f in (("rapida", lambda w, r: w), ("segura", lambda w, r: w * (1 + 10 * r))):
        adj = {}
        for _, u, v, w, r in edges:
            adj.setdefault(u, []).append((v, f(w, r)))
            adj.setdefault(v, []).append((u, f(w, r)))
        for ruta, o, d in (("a", 0, 24), ("b", 20, 4), ("c", 12, 0)):
            row = got[ruta, name]
            assert row["costo"] == pytest.approx(_dijkstra(adj, {o: 0.0})[d])
            by_id = {e[0]: e for e in edges}
            assert row["largo"] == pytest.approx(sum(by_id[t][3] for t in row["tramos"]))


@pytest.mark.parametrize("red,detour,expected", [([], 120.0, "avoided"), (["z"], 120.0, "avoided"), (["z"], 900.0, "detour_limit"), (["z"], None, "no_viable_path")])
def test_avoidance_ladder(spark, red, detour, expected):
    rows = [("s1", 0, 1, 50.0, red), ("s2", 1, 3, 50.0, [])] + ([("s3", 0, 2, detour / 2, []), ("s4", 2, 3, detour / 2, [])] if detour else [])
    full = spark.createDataFrame([(t, u, v, w, 0.1, z, [], z, []) for t, u, v, w, z in rows],
                                 "tramo_id string, u int, v int, largo double, riesgo double, zonas_rojo array<string>, zonas_naranja array<string>, zonas_rojo_margen array<string>, zonas_naranja_margen array<string>")
    req = spark.createDataFrame([("r", 0, 3, ["otra"])], "ruta string, origen int, destino int, exentas array<string>")
    paths = net.shortest_paths(req, net.directed_edges(full), {k: F.col("largo") for k in net.LADDER}, blocked=net.ladder_block(), reads=net.ZONES)
    policy = net.ladder_policy(paths.select("ruta", "variante", F.round(F.col("largo") / 1000, 3).alias("distancia_km"))).first()
    assert policy["rojo"] == expected and policy["naranja"] == "avoided"
    exempt = req.withColumn("exentas", F.array(F.lit("z")))
    free = net.shortest_paths(exempt, net.directed_edges(full), {k: F.col("largo") for k in net.LADDER}, blocked=net.ladder_block(), reads=net.ZONES)
    assert free.filter("variante = 'sin_rojo'").first()["largo"] == pytest.approx(100.0)


def test_separated_peaks_equal_greedy(spark):
    rng = random.Random(4)
    cells = {(rng.randint(0, 25), rng.randint(0, 25)): rng.choice([0.7, 0.8, 0.9, rng.random()]) for _ in range(160)}
    df = spark.createDataFrame([(x, y, (x + 0.5) * 100, (y + 0.5) * 100, s) for (x, y), s in cells.items()], "cx long, cy long, x double, y double, pico double")
    chosen = []
    for (x, y), s in sorted(cells.items(), key=lambda kv: (-kv[1], kv[0])):
        if all(((x - a) * 100) ** 2 + ((y - b) * 100) ** 2 >= 450 ** 2 for a, b in chosen):
            chosen.append((x, y))
    assert {(r["cx"], r["cy"]) for r in surface.separated_peaks(df).collect()} == set(chosen)


def test_same_report_equals_brute_force(spark):
    rng = random.Random(9)
    base = 1_700_000_000
    donors = [(f"d{i:03d}", rng.choice("kq"), base + rng.randint(0, 30) * 3600, -12.0 + rng.choice([0, 0, 1e-4, 5e-3]), -77.0) for i in range(40)]
    asked = [(f"m{i:03d}", rng.choice("kqz"), base + rng.randint(0, 40) * 3600) for i in range(40)]
    d = spark.createDataFrame(donors, "fila string, k string, t long, latitud double, longitud double").withColumn("momento", F.timestamp_seconds("t")).drop("t")
    m = spark.createDataFrame(asked, "fila string, k string, t long").withColumn("momento", F.timestamp_seconds("t")).drop("t")
    got = {r["fila"]: r for r in impute.same_report(m, d, ["k"]).collect()}
    assert len(got) == len(asked)
    for fila, k, t in asked:
        same = [x for x in donors if x[1] == k]
        near = sorted((abs(x[2] - t), x[0], x) for x in same if abs(x[2] - t) <= 6 * 3600)
        if not near:
            assert got[fila]["estado"] == ("fuera_de_6h" if same else "sin_donante")
            continue
        spread = max(111_195 * abs(near[0][2][3] - x[2][3]) for x in near)
        assert got[fila]["estado"] == ("ambiguo" if spread > 20 else "recuperado")
        if spread <= 20:
            assert got[fila]["fila_donante"] == near[0][1] and got[fila]["donantes"] == len(near)
            assert got[fila]["dispersion_m"] == pytest.approx(spread, abs=1e-6)


def test_box_counts_equal_brute_force(spark):
    rng = random.Random(6)
    pts = [(-12 + rng.random() * 0.1, -77 + rng.random() * 0.1) for _ in range(300)] + [(-11.95, -76.95)] * 50
    boxes = [(f"r{i}", *sorted((-12 + rng.random() * 0.1, -12 + rng.random() * 0.1)), *sorted((-77 + rng.random() * 0.1, -77 + rng.random() * 0.1))) for i in range(12)]
    got = {r["ruta"]: r["delitos"] for r in spatial.count_in_boxes(spark.createDataFrame(boxes, "ruta string, s double, n double, w double, e double"), spark.createDataFrame(pts, "latitud double, longitud double"), "ruta", 0.002).collect()}
    for name, s, n, w, e in boxes:
        assert got[name] == sum(s - 0.002 <= a <= n + 0.002 and w - 0.002 <= b <= e + 0.002 for a, b in pts)
    assert len(list(itertools.chain(got))) == 12


def test_paths_are_walked_back_in_order(spark):
    """Every path starts at the origin, ends at the destination and adds up to its cost, also over many steps and for a request that stays where it is."""
    edges = [(f"c{i}", i, i + 1, 10.0 + i % 3, 0.1) for i in range(70)] + [("atajo", 0, 69, 5000.0, 0.0)]
    seg = spark.createDataFrame(edges, "tramo_id string, u int, v int, largo double, riesgo double")
    req = spark.createDataFrame([("lejos", 0, 70), ("vuelta", 70, 3), ("quieto", 5, 5), ("nada", 0, 999)], "ruta string, origen int, destino int")
    got = {(r["ruta"], r["variante"]): r for r in net.shortest_paths(req, net.directed_edges(seg), {"rapida": F.col("largo"), "exposicion": F.col("largo") * F.col("riesgo")}).collect()}
    assert got["lejos", "rapida"]["tramos"] == [f"c{i}" for i in range(70)]
    assert got["lejos", "exposicion"]["tramos"] == ["atajo", "c69"]
    assert got["vuelta", "rapida"]["tramos"] == [f"c{i}" for i in range(69, 2, -1)]
    assert got["quieto", "rapida"]["tramos"] == [] and ("nada", "rapida") not in got


def test_variants_stay_inside_the_detour_ellipse(spark):
    """A cheap way around that leaves the ellipse is not taken."""
    edges = [("recto", 0, 1, 1000.0, 1.0), ("sale", 0, 2, 600.0, 0.0), ("vuelve", 2, 1, 600.0, 0.0), ("cerca", 0, 3, 520.0, 0.1), ("llega", 3, 1, 520.0, 0.1)]
    seg = spark.createDataFrame(edges, "tramo_id string, u int, v int, largo double, riesgo double")
    places = {0: (0.0, 0.0), 1: (0.0, 0.00895), 2: (0.02, 0.0045), 3: (0.001, 0.0045)}
    at = spark.createDataFrame([(n, a, b) for n, (a, b) in places.items()], "hasta int, h_lat double, h_lon double")
    req = spark.createDataFrame([("r", 0, 1, *places[0], *places[1], 0.0)], "ruta string, origen int, destino int, o_lat double, o_lon double, d_lat double, d_lon double, acceso_m double")
    cost = {"rapida": F.col("largo"), "exposicion": F.col("largo") * F.col("riesgo")}
    got = {r["variante"]: r["tramos"] for r in net.route_variants(req, net.directed_edges(seg).join(at, "hasta"), cost, "rapida").collect()}
    assert got == {"rapida": ["recto"], "exposicion": ["cerca", "llega"]}


def test_neighbours_in_one_crowded_cell(spark):
    """Many places within a metre of each other and many points on one spot: ranks equal a plain search."""
    rng = random.Random(11)
    at = [(f"p{i:05d}", rng.random(), rng.random()) for i in range(3000)] + [(f"q{i:05d}", 0.5, 0.5) for i in range(500)] + [("lejos", 4000.0, 0.0)]
    got = defaultdict(list)
    for r in spatial.nearest_neighbors(spark.createDataFrame(at, "tramo_id string, x double, y double"), 4).collect():
        got[r["tramo_id"]].append((r["puesto"], r["vecino_id"]))
    for name, x, y in [at[0], at[1999], at[3100], at[-1]]:
        near = sorted((math.hypot(x - a, y - b), n) for n, a, b in at if n != name)[:4]
        assert [n for _, n in sorted(got[name])] == [n for _, n in near]
    assert len(got) == len(at)


def test_choice_with_the_field_goes_by_avoidable_zones(spark):
    """Metres in a zone that holds an end do not count; the candidate with the fewest others wins, also if it is longer."""
    steps = spark.createDataFrame([("r", "rapida", "a"), ("r", "b1", "b"), ("r", "b2", "c"), ("r", "b2", "d")], "ruta string, variante string, tramo_id string")
    hits = spark.createDataFrame([("a", "z1", "rojo", 40.0), ("b", "z1", "rojo", 25.0), ("c", "z2", "rojo", 90.0), ("d", "z3", "naranja", 5.0)], "tramo_id string, zona string, color string, metros double")
    exempt = spark.createDataFrame([("r", "z2"), ("otra", "z1")], "ruta string, zona string")
    avoid = net.avoidable_metres(steps, hits, exempt, ("ruta", "variante"))
    assert sorted(tuple(r) for r in avoid.collect()) == [("r", "b1", 25.0, 0.0), ("r", "b2", 0.0, 5.0), ("r", "rapida", 40.0, 0.0)]
    rows = avoid.join(spark.createDataFrame([("rapida", 1.0, 9.0, "f0"), ("b1", 1.1, 1.0, "f1"), ("b2", 1.4, 5.0, "f2"), ("lejos", 1.6, 0.1, "f3")], "variante string, distancia_km double, riesgo_total double, firma string"), "variante", "right")
    rows = rows.fillna({"ruta": "r", "rojo_ev": 0.0, "naranja_ev": 0.0}).withColumn("metros_alto", F.lit(0.0)).withColumn("rojo_m", F.col("rojo_ev")).withColumn("naranja_m", F.col("naranja_ev"))
    chosen = net.choose_route(rows.filter("variante <> 'rapida'"), rows.filter("variante = 'rapida'"), with_field=True).first()
    assert chosen["variante"] == "b2" and chosen["rechazo_desvio_excesivo"] == 1


def test_field_puts_the_ring_around_the_hotspots(spark, monkeypatch):
    # samples were repeated in nine cells and broadcast whole.
    points = spark.range(40).selectExpr("id AS tramo_id", "explode(sequence(0, 9)) AS muestra").selectExpr(
        "tramo_id", "muestra", "tramo_id * 30.0D AS x", "muestra * 40.0D AS y")
    spots = spark.createDataFrame([(100.0, 100.0, 0.9), (600.0, 20.0, 0.8), (620.0, 300.0, 0.7)], "x double, y double, pico double")
    seen, near = [], surface.near_points

    def record(queries, targets, radius, hint=None):
        seen.append((queries.columns, hint))
        return near(queries, targets, radius, hint)

    monkeypatch.setattr(surface, "near_points", record)
    got = sorted(map(tuple, surface.field_at(points, spots, ["tramo_id", "muestra"]).collect()))
    monkeypatch.setattr(surface, "BROADCAST_RINGS", 0)
    assert got == sorted(map(tuple, surface.field_at(points, spots, ["tramo_id", "muestra"]).collect()))
    assert seen == [(["x", "y", "pico"], "broadcast"), (["x", "y", "pico"], "merge")]
    want = {}
    for p in points.collect():
        best = (0.0, 0.0)
        for x, y, pico in ((s["x"], s["y"], s["pico"]) for s in spots.collect()):
            d2 = (p["x"] - x) ** 2 + (p["y"] - y) ** 2
            k = math.exp(-4.5 * d2 / 62500)
            i = min(max((pico - 0.6) / 0.4, 0), 1) ** 2 * k
            if d2 <= 62500 and i > 0.025:
                best = max(best, (i, pico * math.sqrt(k)))
        want[p["tramo_id"], p["muestra"]] = best
    assert {(a, b): (i, c) for a, b, c, i in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_peaks_are_scored_once(spark):
    # every round computed the forecast behind the peaks again.
    peaks = spark.range(50).selectExpr("id AS cx", "0L AS cy", "id * 100.0D AS x", "0.0D AS y", "(id % 7) / 7.0D AS pico")
    assert "Range (" not in surface.separated_peaks(peaks)._jdf.queryExecution().executedPlan().toString()


def test_an_edge_meets_each_place_once(spark):
    # all pairs of samples and places were shuffled to find the distinct ones.
    samples = spark.createDataFrame([("a", float(x), 0.0) for x in range(0, 70, 10)] + [("b", 500.0, 0.0), ("b", 500.0, 0.0), ("c", None, 1.0)], "edge string, x double, y double")
    rows = [(float(x), float(y), w) for x in range(-60, 620, 20) for y in (-45, 0, 45) for w in (1, 3)]
    rows += [(60.0, 0.0, 3), (None, 0.0, 1)]
    out = spatial.crimes_near_edges(samples, spark.createDataFrame(rows, "x double, y double, peso int"), 50.0)
    ends = {"a": range(0, 70, 10), "b": (500,)}
    want = {}
    for edge, xs in ends.items():
        hit = [w for x, y, w in rows if x is not None and any(math.hypot(x - e, y) <= 50 for e in xs)]
        want[edge] = (len(hit), float(sum(hit)), sum(hit) / len(hit))
    assert {r["edge"]: (r["cantidad"], r["suma_peso"], r["peso_medio"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [edge" in plan and plan.count("Aggregate [peso") + plan.count("Aggregate [edge") == 2


def test_nearest_on_the_sphere_doubles_its_reach(spark, monkeypatch):
    # every place met all targets within the cap.
    from tramorisk.functions.geo import haversine_m

    spots = [(i, -12.0 + (i % 9) * 0.0031, -77.0 + (i % 14) * 0.0047) for i in range(60)] + [(60, 10.0, 10.0), (61, None, -77.0), (62, -12.0, -77.0)]
    goals = [(f"t{i}", -12.0 + (i * 7 % 23) * 0.0013, -77.0 + (i * 5 % 31) * 0.0021) for i in range(40)] + [("far", -12.0, -77.02)]
    q = spark.createDataFrame(spots, "fila long, lat double, lon double")
    t = spark.createDataFrame(goals, "destino string, t_lat double, t_lon double")
    reaches, within = [], spatial._within_haversine
    monkeypatch.setattr(spatial, "_within_haversine", lambda s, o, cap: (reaches.append(cap), within(s, o, cap))[1])
    got = {r["fila"]: (r["destino"], r["dist_m"]) for r in spatial.nearest_by_haversine(q, t, "fila", 1000.0).collect()}
    all_ = q.crossJoin(t).withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).filter("d <= 1000")
    want = {r["fila"]: (r["m"]["destino"], r["m"]["d"]) for r in all_.groupBy("fila").agg(F.min(F.struct("d", "destino")).alias("m")).collect()}
    assert got == {s[0]: want.get(s[0], (None, None)) for s in spots}
    assert reaches == [125.0, 250.0, 500.0, 1000.0]


def test_a_search_carries_its_front_only(spark, monkeypatch):
    # Every round rewrote the labels of all nodes reached so far.
    rng = random.Random(13)
    edges = [(f"h{x}_{y}", y * 40 + x, y * 40 + x + 1, float(rng.randint(1, 3)), 0.0) for x in range(39) for y in range(3)]
    edges += [(f"v{x}_{y}", y * 40 + x, y * 40 + x + 40, float(rng.randint(1, 3)), 0.0) for x in range(40) for y in range(2)]
    seg = spark.createDataFrame(edges, "tramo_id string, u int, v int, largo double, riesgo double")
    req = spark.createDataFrame([("r", 0, 119)], "ruta string, origen int, destino int")
    seen, final = [], net._final_labels

    def record(*args):
        out = final(*args).localCheckpoint()
        seen.append((out.count(), out.filter("fuera").count()))
        return out

    monkeypatch.setattr(net, "_final_labels", record)
    got = net.shortest_paths(req, net.directed_edges(seg), {"rapida": F.col("largo")}).first()
    assert len(seen) > 4 and max(n for n, _ in seen) < 90 and sum(n for _, n in seen) > 100
    size, ends = {e[0]: e[3] for e in edges}, {e[0]: set(e[1:3]) for e in edges}
    best, at = dict.fromkeys(range(120), math.inf) | {0: 0.0}, 0
    for _ in range(120):
        for _, u, v, d, _ in edges:
            best[v], best[u] = min(best[v], best[u] + d), min(best[u], best[v] + d)
    assert got["largo"] == best[119] == sum(size[t] for t in got["tramos"])
    for t in got["tramos"]:
        (at,) = ends[t] - {at}
    assert at == 119


def test_one_way_steps_stay_until_their_search_ends(spark):
    """Without a way back a final label may still be met by one found later, so it does not leave."""
    line = [(f"c{i}", i, i + 1, 1.0, 0.0) for i in range(14)] + [("lento", 0, 15, 11.0, 0.0), ("entra", 15, 1, 1.0, 0.0), ("fin", 15, 14, 9.0, 0.0)]
    seg = spark.createDataFrame(line, "tramo_id string, u int, v int, largo double, riesgo double")
    req = spark.createDataFrame([("r", 0, 14), ("atras", 14, 0)], "ruta string, origen int, destino int")
    labels = net.shortest_labels(req, net.directed_edges(seg, two_way=False), {"rapida": F.col("largo")}).filter("ruta = 'r'").collect()
    assert {r["nodo"]: r["costo"] for r in labels} == {i: float(i) for i in range(15)} | {15: 11.0}
    assert len(labels) == 16


def test_tasks_follow_the_places(spark, monkeypatch):
    # places were grouped by a fixed number of tasks, whose tables grew with the input.
    from tramorisk import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    rows = spark.range(500).selectExpr("CAST(id % 250 AS DOUBLE) AS x", "0.0D AS y", "0 AS mes_idx", "0 AS turno_idx", "1 AS peso")
    lines = spark.createDataFrame([("a", [(0.0, 1.0, 300.0, 1.0)])], "tramo_id string, piezas array<struct<x1: double, y1: double, x2: double, y2: double>>")
    for out in (spatial.snap(rows, lines, 5.0), spatial.buffer_shift_panel(rows, lines, 5.0)):
        assert "(x" in out._jdf.queryExecution().executedPlan().toString() and ", 50), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert spatial.snap(rows, lines, 5.0).count() == 250


def test_searches_in_tasks_equal_shared_relaxation(spark, monkeypatch):
    # Every round of all searches was a join and an aggregation of its own.
    rng = random.Random(29)
    edges = [(f"h{x}_{y}", y * 9 + x, y * 9 + x + 1, float(rng.randint(1, 4)), rng.randint(0, 3) / 10) for x in range(8) for y in range(7)]
    edges += [(f"v{x}_{y}", y * 9 + x, y * 9 + x + 9, float(rng.randint(1, 4)), rng.randint(0, 3) / 10) for x in range(9) for y in range(6)]
    edges += [("doble", 3, 4, 1.0, 0.1), ("doble2", 3, 4, 1.0, 0.1), ("isla", 90, 91, 1.0, 0.0)]
    seg = spark.createDataFrame([(*e, ["z"] if rng.random() < 0.2 else []) for e in edges], "tramo_id string, u int, v int, largo double, riesgo double, zonas array<string>")
    ends = [(rng.randrange(63), rng.randrange(63)) for _ in range(25)] + [(0, 90), (5, 5), (7, 999), (999, 999)]
    req = spark.createDataFrame([(f"{a}>{b}", a, b, ["z"] if (a + b) % 3 else [], float(a % 5)) for a, b in ends], "ruta string, origen int, destino int, libres array<string>, q double").dropDuplicates(["ruta"])
    costs = {"rapida": F.col("largo"), "exposicion": F.col("largo") * F.col("riesgo")}
    shut = F.size(F.array_except("zonas", "libres")) > 0
    edges = net.directed_edges(seg)
    kept = lambda **k: sorted((r["ruta"], r["variante"], r["costo"], r["expo"], r["largo"], *r["tramos"]) for r in net.shortest_paths(req, edges, costs, **k).collect())
    cases = [{}, {"blocked": shut, "reads": ("zonas",)}, {"blocked": shut & (F.col("variante") == "rapida"), "reads": ("zonas",)}]
    plan = net.shortest_paths(req, edges, costs)._jdf.queryExecution().executedPlan().toString()
    inside = [kept(**c) for c in cases]
    monkeypatch.setattr(net, "GRAPH_BYTES", 0)
    assert inside == [kept(**c) for c in cases] and len(inside[0]) > 40
    assert inside[0] != inside[1] != inside[2] and "MapInArrow" in plan


def test_box_edges_sort_the_places_of_a_cell_once(spark):
    # every box met all places of the cells on its edges.
    rng = random.Random(8)
    pts = [(-12 + rng.random() * 0.03, -77 + rng.random() * 0.03) for _ in range(900)] + [(-11.99, -76.99)] * 30 + [(None, -77.0)]
    boxes = [(f"r{i}", *sorted((-12 + rng.random() * 0.03, -12 + rng.random() * 0.03)), *sorted((-77 + rng.random() * 0.03, -77 + rng.random() * 0.03))) for i in range(40)]
    boxes.append(("punto", -11.99, -11.99, -76.99, -76.99))
    b = spark.createDataFrame(boxes, "ruta string, s double, n double, w double, e double")
    out = spatial.count_in_boxes(b, spark.createDataFrame(pts, "latitud double, longitud double"), "ruta", 0.0)
    assert {r["ruta"]: r["delitos"] for r in out.collect()} == {k: sum(a is not None and s <= a <= n and w <= c <= e for a, c in pts) for k, s, n, w, e in boxes}
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_cells_of_lines_are_not_broadcast_unmeasured(spark, monkeypatch):
    # The cells of all segments were broadcast, as the planner took them for the small file behind them.
    lines = spark.createDataFrame([(f"s{i}", [(i * 50.0, 0.0, i * 50.0 + 90.0, 30.0), (i * 50.0 + 90.0, 30.0, i * 50.0 + 90.0, 80.0)]) for i in range(30)],
                                  "tramo_id string, piezas array<struct<x1: double, y1: double, x2: double, y2: double>>")
    points = spark.range(300).selectExpr("CAST(id * 5 AS DOUBLE) AS x", "CAST(id % 40 AS DOUBLE) AS y")
    near = lambda: spatial.near_polylines(points, lines, 60.0)
    kept = lambda: sorted(map(tuple, near().select("x", "y", "tramo_id", "dist_m").collect()))
    want = kept()
    monkeypatch.setattr(spatial, "BROADCAST_LINES", 0)
    assert want and kept() == want
    plan = near()._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan
