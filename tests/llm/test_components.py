import random

from stormcell.llm.components import _large_star, _small_star, components


def test_paths_stars_and_cycles(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5), (3001, 3000), (3001, 3000)]
    r.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1050)}
    want |= {i: 2000 for i in (2000, 2001, 2002)} | {3000: 3000, 3001: 3000}
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_step_has_few_copies_of_its_edges(spark):
    edges = spark.range(9).selectExpr("id AS u", "id + 1 AS v")
    step = _small_star(_large_star(edges))
    plan = step._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Range (") <= 4, plan
    assert {tuple(r) for r in step.where("u <> v").distinct().collect()} == {
        (i, max(0, i - 2)) for i in range(1, 10)}
