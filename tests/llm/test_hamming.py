import random

from tidewright.llm import hamming


def brute(rows, k):
    codes = {(i, sum(1 << b for b, x in enumerate(v[:64]) if x is not None and x > 0)) for i, v in rows if i is not None and v is not None}
    out = {}
    for i, c in codes:
        if i % 50 == 0:
            for j, d in codes:
                if j != i:
                    near = out.setdefault(i, {})
                    near[j] = min(near.get(j, 99), (c ^ d).bit_count())
    return {i: sorted((d, j) for j, d in near.items())[:k] for i, near in out.items()}


def run(spark, rows, k=10):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS distance", "1 AS code")
    out = {}
    for r in hamming.search(frame, hamming.Params(k=k)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["distance"], r["neighbour_id"]))
    return out


def test_equals_comparing_all(spark):
    r = random.Random(8)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.uniform(-0.3, 0.3) for x in r.choice(centres)]) for i in range(400)]
    rows += [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(400, 500)]
    rows += [(i, centres[0]) for i in range(500, 800)]  # one very common code
    assert run(spark, rows) == brute(rows, 10)


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, [1.0, None]), (2, None), (None, [1.0]), (3, []), (3, []), (50, [1.0] * 70), (50, [-1.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [(0, [1.0])]) == {} and run(spark, []) == {}
