import numpy as np

from lastleg.operators import routing as R


def problem(n, seed=0):
    random = np.random.default_rng(seed)
    minutes = random.uniform(1, 30, (n + 1, n + 1))
    np.fill_diagonal(minutes, 0)
    return minutes, np.concatenate(([0.0], random.integers(1, 10, n).astype(float)))


def test_savings_serve_every_client_once_within_limits():
    for n in (0, 1, 2, 30):
        minutes, demand = problem(n, n)
        routes = R.savings_routes(minutes, demand, 40, 300)
        assert sorted(c for r in routes for c in r) == list(range(1, n + 1))
        assert all(demand[r].sum() <= 40 and R.route_minutes(r, minutes, 5, 10) <= 300 + 1e-6 for r in routes)


def test_search_is_no_worse_than_savings():
    minutes, demand = problem(25, 3)
    total = lambda routes: sum(R.route_minutes(r, minutes, 5.0, 10.0) for r in routes)
    assert total(R.iterated_search(minutes, demand, 40, 300)) <= total(R.savings_routes(minutes, demand, 40, 300)) + 1e-9


def test_two_opt_on_a_directed_matrix():
    minutes, _ = problem(7, 5)
    route = list(range(1, 8))
    better = R.two_opt(route, minutes)
    assert sorted(better) == route
    assert R.route_minutes(better, minutes, 0, 0) <= R.route_minutes(route, minutes, 0, 0)


def test_greedy_assignment_keeps_to_the_capacity():
    from lastleg.operators.assignment import greedy_capacity

    metres = np.array([[1.0, 2.0], [1.0, 2.0], [1.0, np.nan], [3.0, 4.0]])
    assert greedy_capacity(metres, np.array([2.0, 2.0, 2.0, 2.0]), 4.0).tolist() == [0, 0, 1, 1]
    assert greedy_capacity(metres, np.array([5.0, 4.0, 4.0, 1.0]), 4.0).tolist() == [-1, 0, 1, -1]


def test_search_tries_as_often_and_as_widely_as_the_reference(monkeypatch):
    """Ten full vehicles can't be improved: steps of a tenth, two destructions of all, from the start again, 20 tries."""
    freed, savings = [], R.savings_routes

    def counted(minutes, demand, *rest):
        if any(isinstance(r, np.random.Generator) for r in rest):
            freed.append(len(minutes) - 1)
        return savings(minutes, demand, *rest)

    monkeypatch.setattr(R, "savings_routes", counted)
    minutes, _ = problem(10, 1)
    R.iterated_search(minutes, np.array([0.0] + [9.0] * 10), 9, 300)
    assert freed == [*range(1, 11), 10, *range(1, 10)]


def test_biased_order_takes_all_and_the_best_first():
    order = np.arange(5000)
    got = list(R.biased_order(order, np.random.default_rng(0)))
    assert sorted(got) == order.tolist() and got != order.tolist()
    assert all(k <= place + R.WINDOW for place, k in enumerate(got)) and np.mean(got[:100]) < 100


def test_savings_are_the_same_in_small_batches_and_without_a_matrix(monkeypatch):
    """Many clients share a place, so that most savings are ties."""
    random = np.random.default_rng(2)
    lat, lon = 41 + random.integers(0, 5, 121) / 200, 2 + random.integers(0, 5, 121) / 200
    demand = np.concatenate(([0.0], random.integers(1, 6, 120).astype(float)))
    minutes = R.haversine_matrix(lat, lon) * 1.3 / 20.0 * 60
    want = R.savings_routes(minutes, demand, 60, 480)
    monkeypatch.setattr(R, "HELD", 40)
    monkeypatch.setattr(R, "CELLS", 300)
    for most in (2048, 0):
        monkeypatch.setattr(R, "MATRIX", most)
        ways, every = R.Ways(lat, lon, 1.3, 20.0), np.arange(121)
        assert (ways[np.ix_(every, every)] == minutes).all()
        assert R.savings_routes(ways, demand, 60, 480) == R.savings_routes(minutes, demand, 60, 480) == want


def test_assignment_in_small_blocks_over_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lastleg.operators import assignment

    customers = spark.range(300).select(F.col("id").alias("customer_id"), (41 + F.col("id") % 7 / 100).alias("lat"), (2 + F.col("id") % 11 / 100).alias("lon"), (1 + F.col("id") % 5).alias("demand"), (F.col("id") % 6).alias("section"))
    sites = spark.range(60).select(F.col("id").alias("facility_id"), (41 + F.col("id") % 5 / 100).alias("lat"), (2 + F.col("id") % 3 / 100).alias("lon"), (F.col("id") % 6).alias("company"))
    want = sorted(assignment.assign_capacity(customers, sites, 15.0).collect(), key=lambda r: r.customer_id)
    monkeypatch.setattr(assignment, "CELLS", 25)
    small = assignment.assign_capacity(customers, sites, 15.0)
    assert sorted(small.collect(), key=lambda r: r.customer_id) == want and len(want) == 300
    assert small.rdd.mapPartitions(lambda part: [any(True for _ in part)]).filter(bool).count() > 1


def test_problems_are_solved_by_several_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(120).select((F.col("id") % 12).alias("problem_id"), F.col("id").alias("client_id"), (41 + F.col("id") / 1000).alias("lat"), F.lit(2.0).alias("lon"), F.lit(1).alias("demand"), F.lit(41.0).alias("depot_lat"), F.lit(2.1).alias("depot_lon"))
    plans = R.solve(rows, improve=True)
    assert plans.select("problem_id").distinct().count() == 12
    assert plans.rdd.mapPartitions(lambda part: [any(True for _ in part)]).filter(bool).count() > 2
