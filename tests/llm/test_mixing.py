import math
import random

import pytest

from foliant.llm import mixing as M

pytest.importorskip("tiktoken")


def test_rate_has_the_mean_under_the_cut():
    for most in (1, 2, 4, 9):
        for mean in (0.05, 0.5, 0.9 * most):
            rate = M.solve_rate(mean, most)
            assert M.capped_mean(rate, most) == pytest.approx(mean, abs=1e-9)
            u = [random.Random(8).random() for _ in range(1)] + [k / 20_000 for k in range(20_000)]
            t = M.thresholds(rate, most)
            assert sum(sum(x >= y for y in t) for x in u) / len(u) == pytest.approx(mean, abs=2e-3)
    assert math.isinf(M.solve_rate(3, 3)) and M.thresholds(math.inf, 3) == [0.0] * 3


def test_plan_takes_what_every_source_can_give():
    got = M.plan({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.1, 5)])
    assert [x[0] for x in got] == ["a", "b"] and got[1][3] == [0.0, 0.0]


def test_query(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, r.choice(["a", "a", "a", "b", None, "z"]), "palavra " * r.randrange(1, 30), "x") for i in range(4000)] + [(9001, "a", None, "x"), (9002, "b", "", "x"), (7, "a", "repetido", "x")], "doc_id bigint, source string, text string, copy string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = M.mix(docs, targets).collect()
    assert {x.source for x in got} == {"a", "b"} and all(abs(x.reached_share - x.target_share) < 0.03 for x in got)
    assert max(x.copy for x in got if x.source == "a") == 1 and max(x.copy for x in got if x.source == "b") <= 3
    assert [x.shuffle_key for x in got] == sorted(x.shuffle_key for x in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(docs.repartition(7), targets).collect()))
    total = sum(x.n_tokens for x in got)
    assert {x.source: round(x.reached_share, 9) for x in got} == {s: round(sum(x.n_tokens for x in got if x.source == s) / total, 9) for s in "ab"}
    assert M.mix(docs.limit(0), targets).count() == 0 and M.report(M.mix(docs, targets)).count() == 2
