"""Legs and models by hand, kernels against brute force, matrices."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastleg.functions.cost import RATES
from lastleg.operators import assignment, matrices, routing
from lastleg.plans import legs, models


def plain_savings(minutes, demand, capacity, limit, service, preparation, deadline=None):
    """Clarke-Wright as it is told: lists, one merge at a time."""
    n = len(minutes) - 1
    cost = lambda r: preparation + service * len(r) + sum(minutes[a][b] for a, b in zip([0, *r], [*r, 0], strict=True))
    routes = [[k] for k in range(1, n + 1)]
    fewest = max(math.ceil(sum(demand) / capacity), math.ceil(n / max(1, math.floor((limit - preparation) / service))))
    pairs = sorted((-(minutes[i][0] + minutes[0][j] - minutes[i][j]), i, j) for i, j in itertools.permutations(range(1, n + 1), 2))
    for _, i, j in pairs:
        if len(routes) <= fewest:
            break
        p = next((r for r in routes if r[-1] == i), None)
        q = next((r for r in routes if r[0] == j), None)
        if p is None or q is None or p is q or sum(demand[c] for c in p + q) > capacity or cost(p + q) > limit + 1e-9:
            continue
        if deadline is not None and cost(p + q) - minutes[q[-1]][0] > deadline + 1e-9:
            continue
        routes[routes.index(p)] = p + q
        routes.remove(q)
    return sorted(routes)


@pytest.mark.parametrize("seed", range(8))
def test_savings_equal_the_plain_ones(seed):
    random = np.random.default_rng(seed)
    n = int(random.integers(1, 18))
    minutes = random.integers(1, 12, (n + 1, n + 1)).astype(float)  # ties
    np.fill_diagonal(minutes, 0)
    demand = np.concatenate(([0.0], random.integers(1, 6, n).astype(float)))
    for deadline in (None, 70.0):
        got = routing.savings_routes(minutes, demand, 15, 90, 5.0, 10.0, deadline=deadline)
        assert sorted(got) == plain_savings(minutes.tolist(), demand.tolist(), 15, 90, 5.0, 10.0, deadline)


def test_savings_in_small_chunks_are_the_same(monkeypatch):
    random = np.random.default_rng(2)
    minutes, demand = random.uniform(1, 30, (41, 41)), np.concatenate(([0.0], random.integers(1, 9, 40).astype(float)))
    want = routing.savings_routes(minutes, demand, 40, 300)
    monkeypatch.setattr(routing, "CHUNK", 7)
    assert routing.savings_routes(minutes, demand, 40, 300) == want


def test_reversal_never_loses_a_client():
    random = np.random.default_rng(3)
    minutes = random.uniform(1, 30, (31, 31))
    minutes = (minutes + minutes.T) / 2
    np.fill_diagonal(minutes, 0)
    demand = np.concatenate(([0.0], np.ones(30)))
    plain, turned = (routing.savings_routes(minutes, demand, 10, 200, reversal=x) for x in (False, True))
    total = lambda routes: sum(routing.route_minutes(r, minutes, 5, 10) for r in routes)
    assert sorted(c for r in turned for c in r) == list(range(1, 31))
    assert all(routing.route_minutes(r, minutes, 5, 10) <= 200 + 1e-6 for r in turned) and total(turned) <= total(plain) * 1.2


@pytest.mark.parametrize("seed", range(5))
def test_two_opt_leaves_no_better_reversal(seed):
    random = np.random.default_rng(seed)
    minutes = random.uniform(1, 30, (9, 9))
    route = routing.two_opt(list(range(1, 9)), minutes)
    cost = lambda r: sum(minutes[a, b] for a, b in zip([0, *r], [*r, 0], strict=True))
    for s, e in itertools.combinations(range(8), 2):
        assert cost(route[:s] + route[s : e + 1][::-1] + route[e + 1 :]) >= cost(route) - 1e-9


def test_relocation_keeps_limits_and_saves():
    random = np.random.default_rng(6)
    minutes = random.uniform(1, 30, (21, 21))
    demand = np.concatenate(([0.0], random.integers(1, 5, 20).astype(float)))
    routes = [list(range(k, k + 4)) for k in range(1, 21, 4)]
    better = routing.relocate(routes, minutes, demand, 16, 400, 5.0, 10.0, share=1.0)
    total = lambda rs: sum(routing.route_minutes(r, minutes, 5, 10) for r in rs)
    assert sorted(c for r in better for c in r) == list(range(1, 21)) and total(better) < total(routes)
    assert all(demand[r].sum() <= 16 for r in better)


def test_invalid_cells():
    km = np.ones((60, 60))
    km[5, :] = np.nan
    assert routing.sanitised(km, np.ones((60, 60))).tolist() == [k for k in range(60) if k != 5]
    km[7, 9] = np.inf
    with pytest.raises(ValueError, match="invalid"):
        routing.sanitised(km, np.ones((60, 60)))


def test_given_matrices_and_failures_of_one_problem(spark):
    clients = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0), (2, 20, 999.0)], "problem_id bigint, client_id bigint, demand double")
    cells = [(1, o, d, 1.0, 4.0) for o in (None, 10, 11) for d in (None, 10, 11) if o != d] + [(2, None, 20, 1.0, 1.0), (2, 20, None, 1.0, 1.0)]
    m = spark.createDataFrame(cells, "problem_id bigint, o bigint, d bigint, km double, minutes double")
    rows = {r.problem_id: r for r in routing.solve_matrix(clients, m).collect()}
    assert (rows[1].clients, rows[1].km, rows[1].travel_min, rows[1].minutes, rows[1].status) == ([10, 11], 3.0, 12.0, 32.0, "ok")
    assert rows[1].arrive_min == [14.0, 23.0] and "capacity" in rows[2].status
    assert [(r.position, r.client_id) for r in routing.stops_of(routing.solve_matrix(clients, m).where("problem_id = 1")).orderBy("position").collect()] == [(1, 10), (2, 11)]


def test_three_clients_by_hand(spark):
    """One short route to three clients: its time is the way there, through and back, three services and the preparation."""
    c = spark.createDataFrame([(1, 1, 41.0, 2.01, 2, 30.0), (1, 2, 41.0, 2.02, 3, 0.0), (1, 3, 41.0, 2.03, 1, 60.0)], "problem_id bigint, client_id bigint, lat double, lon double, demand int, snap_m double")
    c = c.withColumns({"depot_lat": F.lit(41.0), "depot_lon": F.lit(2.0)})
    [route] = legs.delivery(c, "driving", 60.0, snap="snap_m").collect()
    step = 2 * 6371 * math.asin(math.cos(math.radians(41)) * math.sin(math.radians(0.01) / 2)) * legs.DETOUR
    assert sorted(route.clients) == [1, 2, 3] and route.km == pytest.approx(6 * step, abs=1e-3) and route.load == 6
    assert route.access_km == pytest.approx(0.18) and route.access_min == pytest.approx(0.18 / 5 * 60)
    assert route.minutes == pytest.approx(10 + 6 * step / 20 * 60 + 15 + 0.18 / 5 * 60, abs=1e-2)
    way = legs.totals(legs.delivery(c, "driving", 60.0, snap="snap_m"), "direct")
    [m1, m2] = models.compare(way, c.agg(F.sum("demand").alias("packages"))).orderBy("model").collect()  # no other leg is given
    paid = (route.minutes - 10) / 60 * RATES["labour_h"]
    assert (m1.model, m1.trips, m1.packages) == ("M1", 1, 6) and m1.km == pytest.approx(6 * step + 0.18, abs=1e-3)
    assert m1.cost_eur == pytest.approx(route.km * 0.25 + paid, abs=1e-3) and m2.cost_eur == pytest.approx(route.km * 0.30 + paid, abs=1e-3)
    assert m1.co2_kg == pytest.approx(route.km * 0.18, abs=1e-3) and m2.co2_kg == 0


def test_all_models_have_all_their_legs(spark):
    rows = [(k, 41.0 + k % 5 / 500, 2.0 + k % 7 / 500, 1 + k % 3, float(k % 40), k // 20) for k in range(40)]
    c = spark.createDataFrame(rows, "customer_id bigint, lat double, lon double, demand int, snap_m double, zone bigint")
    f = spark.createDataFrame([(1, 41.002, 2.002, 2), (2, 41.006, 2.006, 2), (3, 41.001, 2.008, 1), (4, 50.0, 9.0, 3)], "facility_id bigint, lat double, lon double, group int")
    plans = models.plan_all(c, f, (41.1, 2.1), supply_capacity=20.0)
    packages = sum(r[3] for r in rows)
    assert plans["direct"].agg(F.sum("load")).first()[0] == packages == plans["cycling"].agg(F.sum("load")).first()[0]
    assert plans["supply_microhub"].agg(F.sum("load"), F.max("load")).first() == (packages, 20.0)
    last = plans["cycling"].where("status = 'ok'").select("problem_id", "starts", "ends", "minutes").collect()
    assert {r.problem_id for r in last} == {1, 2} and all(r.ends == pytest.approx(r.starts + r.minutes) and r.starts > 540 for r in last)
    assert plans["collection"].count() == 40
    got = {r.model: r for r in models.compare_all(c, f, (41.1, 2.1), supply_capacity=20.0).collect()}
    assert sorted(got) == ["M1", "M2", "M3", "M4", "M5"] and all(r.packages == packages for r in got.values())
    assert got["M5"].trips == got["M4"].trips - plans["walking"].count() + 40 and got["M1"].co2_kg > 0 == got["M3"].co2_kg


def test_supply_visits_of_nothing(spark):
    loads = spark.createDataFrame([(1, 450.0), (2, 0.0), (3, 200.0), (4, -1.0)], "facility_id bigint, load double")
    got = sorted((r.facility_id, r.visit, r.load) for r in legs.supply_visits(loads, ["facility_id"], 200.0).collect())
    assert got == [(1, 1, 200.0), (1, 2, 200.0), (1, 3, 50.0), (3, 1, 200.0)]


def test_capacity_assignment_against_a_plain_loop(spark):
    random = np.random.default_rng(1)
    c = [(k, int(k % 2), float(41 + random.random() / 50), float(2 + random.random() / 50), int(1 + k % 4)) for k in range(50)]
    f = [(k, int(k % 2), float(41 + random.random() / 50), float(2 + random.random() / 50)) for k in range(6)]
    customers = spark.createDataFrame(c, "customer_id bigint, section int, lat double, lon double, demand int")
    sites = spark.createDataFrame(f, "facility_id bigint, company int, lat double, lon double")
    got = {r.customer_id: r.facility_id for r in assignment.assign_capacity(customers, sites, 18.0).collect()}
    load, want = {k: 0 for k, *_ in f}, {}
    for k, g, y, x, need in c:
        way = lambda s: round(2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(s[2] - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(s[2])) * math.sin(math.radians(s[3] - x) / 2) ** 2)), 3)  # noqa: E731, B023
        free = [s for s in f if s[1] == g and load[s[0]] + need <= 18]
        want[k] = min(free, key=lambda s: (way(s), s[0]))[0] if free else None
        if free:
            load[want[k]] += need
    assert {k: None if v is None or v != v else int(v) for k, v in got.items()} == want


def test_matrix_blocks_table_and_cache(spark):
    p = spark.createDataFrame([(1, k, 41.0 + k / 100, 2.0) for k in range(7)] + [(2, 0, 41.0, 2.0)], "problem_id bigint, k bigint, lat double, lon double")
    whole = {(r.problem_id, r.o, r.d): r.km for r in matrices.square(p, matrices.GreatCircle(20.0), block=100).collect()}
    parts = {(r.problem_id, r.o, r.d): r.km for r in matrices.square(p, matrices.GreatCircle(20.0), block=3).collect()}
    assert parts == whole and len(whole) == 50
    known = spark.createDataFrame([(1, 0, 1, 5.0, 6.0)], "problem_id bigint, o bigint, d bigint, km double, minutes double")
    got = {(r.problem_id, r.o, r.d): r.km for r in matrices.square(p, matrices.Table(known)).collect()}
    assert len(got) == 50 and got[1, 0, 1] == 5.0 and got[1, 1, 0] is None
    store = matrices.Cache(spark)
    provider = matrices.GreatCircle(20.0)
    assert store.key(p, provider) == store.key(p.orderBy(F.desc("k")), provider) != store.key(p.where("k < 6"), provider)
    assert store.square(p, provider).count() == store.square(p, provider).count() == 50


def test_bad_demand_fails(spark):
    names = {"ID": "customer_id", "D": "demand", "S": "scenario"}
    rows = lambda d, s: spark.createDataFrame([("1", d, s)], "ID string, D string, S string")
    assert matrices.checked_demand(rows("2", "low"), names, "low").count() == 1
    assert matrices.checked_demand(rows("x", "low"), names, "low").count() == 0
    for bad in (rows("0", "low"), rows("2", "high")):
        with pytest.raises(Exception, match="demand must be positive|scenario is not"):
            matrices.checked_demand(bad, names, "low").collect()
