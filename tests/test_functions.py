from __future__ import annotations

import json
import math
import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import math as M
from tessera.functions import skeleton as S
from tessera.functions import text as T
from tessera.functions import arrays as A
from tessera.operators import batches, execution, generation, index, losses, metrics, partitioning, pool, rollouts, vectors
from tessera.plans import shapes
from tessera.sources import files, shared
from tessera.streaming import buffer

GOLDENS = [
    ("SELECT name FROM singer WHERE age > 30", "SELECT _ FROM _ WHERE _ > _"),
    ("select count(*) from t -- c", "SELECT COUNT(*) FROM _"),
    ("SELECT a.x AS y FROM t AS a JOIN u b ON a.i=b.i LIMIT 5;", "SELECT _ FROM _ JOIN _ ON _ = _ LIMIT _"),
    ("SELECT '--not a comment' FROM t", "SELECT _ FROM _"),
    ("SELECT -1, x FROM `a b` WHERE y != 'it''s'", "SELECT _, _ FROM _ WHERE _ <> _"),
    ("SELECT x FROM (SELECT y AS x FROM t) s WHERE x IN (1, 2)", "SELECT _ FROM (SELECT _ FROM _) WHERE _ IN (_, _)"),
    ("WITH c AS (SELECT 1) SELECT * FROM c", "WITH _ AS (SELECT _) SELECT * FROM _"),
    ("SELECT CAST(a AS REAL) / b c FROM t GROUP BY d HAVING MAX(e) >= 2 ORDER BY f DESC", "SELECT CAST(_ AS REAL) / _ FROM _ GROUP BY _ HAVING MAX(_) >= _ ORDER BY _ DESC"),
    ("SELECT CASE WHEN a IS NULL THEN 'x' ELSE b END z FROM t", "SELECT CASE WHEN _ IS NULL THEN _ ELSE _ END FROM _"),
    ("SELECT DISTINCT t.* FROM t LEFT JOIN u USING (i) UNION ALL SELECT a || b FROM v", "SELECT DISTINCT _ FROM _ LEFT JOIN _ USING (_) UNION ALL SELECT _ || _ FROM _"),
]


@pytest.mark.parametrize("sql,want", GOLDENS)
def test_skeletons(sql, want):
    assert S.mask(sql) == want


@pytest.mark.parametrize("sql", ["SELECT (", "", "hello", "SELECT a FROM", "SELECT a, FROM t WHERE", "SELECT 'open FROM t", "SELECT a = FROM t", "SELECT FROM t", "SELECT a FROM t WHERE x NOT 3", "SELECT a b c FROM t"])
def test_what_is_no_query(sql):
    found, error = S.attempt(S.mask, sql)
    assert found is None and error


@pytest.mark.parametrize("sql,want", [("a/*x*/b", "a b"), ("'--'", "'--'"), ('"/*"', '"/*"'), ("[--]", "[--]"), ("'it''s'--x", "'it''s' ")])
def test_comments(sql, want):
    assert S.strip_comments(sql) == want


def test_bag_jaccard_goldens(spark):
    df = spark.createDataFrame([("a b b", "a b c"), ("a b", "b a"), ("a", "b"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.bag_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_reward_goldens(spark):
    gold = "SELECT 1"
    rows = [
        (f"<think>\nx\n</think>\n<answer>\n{gold}\n</answer>", 1.0),
        (f"Just the SQL: {gold}", 0.0),
        (gold, 0.0),
        (f"<think>\nx\n</think>\n<answer>\n{gold}\n</answer>\ntrailing", 1.0),
        (f" <think>\nx\n</think>\n<answer>\n{gold}\n</answer>", 0.0),
    ]
    df = spark.createDataFrame(rows, "x string, want double")
    assert all(r[0] == r[1] for r in df.select(T.format_reward(F.col("x")), "want").collect())
    r = df.select(execution.rewards(F.col("x"), F.lit(True)).alias("r")).collect()
    assert [x.r.score for x in r] == [4.0, 3.0, 3.0, 4.0, 3.0]
    assert [(x.r.acc_exec, x.r.acc_strict) for x in r[:3]] == [(True, True), (True, False), (True, False)]


def test_advantage_goldens(spark):
    df = spark.createDataFrame([("u", i, r) for i, r in enumerate([4.0, 1.0, 1.0, 0.0])] + [("v", 0, 4.0)], "uid string, sample int, reward double")
    get = lambda x: [round(r.advantage, 4) for r in x.orderBy("uid", "sample").collect()]
    assert get(rollouts.grpo(df, False)) == [2.5, -0.5, -0.5, -1.5, 4.0]
    assert get(rollouts.grpo(df)) == [1.4434, -0.2887, -0.2887, -0.866, 4.0]
    assert get(rollouts.rloo(df)) == [3.3333, -0.6667, -0.6667, -2.0, 4.0]
    assert get(rollouts.pass_at_k(df.where("uid = 'u'"))) == [3.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="fewer than two"):
        rollouts.pass_at_k(df).collect()


def test_farthest_first_goldens(spark):
    vectors_ = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "id long, embedding array<double>")
    old = spark.createDataFrame([(9, [1.0, 0.0])], "id long, embedding array<double>")
    start = vectors.distance_to(vectors_, old, "id")
    got = vectors.farthest_first(vectors_, start, "id", 3).orderBy("selection_rank").collect()
    assert [(r.id, round(r.distance, 9)) for r in got] == [(2, 2.0), (1, 1.0), (0, 0.0)]
    lonely = vectors.outliers(vectors_.where("id = 0"), "id", 1).head()
    assert (lonely.mean_sim, lonely.outlier) == (0.0, 1.0)
    with pytest.raises(ValueError):
        vectors.keep_inliers(vectors.outliers(vectors_, "id", 1), 0.5, 4)


def test_nearest_in_blocks(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(90, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, df, "id", 3, same=True, block=16).collect():
        got.setdefault(r.query, {})[r.rank] = r.neighbour
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    for i in range(90):
        assert [got[i][k] for k in (1, 2, 3)] == np.argsort(-s[i], kind="stable")[:3].tolist()


def test_batch_goldens(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3])], "k long, obs int")
    order = lambda df: [r.obs for r in df.orderBy("pos").collect()]
    assert order(batches.repeat(x, 2)) == [1, 1, 2, 2, 3, 3] and order(batches.repeat(x, 2, False)) == [1, 2, 3, 1, 2, 3]
    for divisor, want in ((2, [1, 2, 3, 1]), (3, [1, 2, 3]), (7, [1, 2, 3, 1, 2, 3, 1])):
        assert [r.obs for r in batches.pad_to_divisor(x, 3, divisor).orderBy("k").collect()] == want
    with pytest.raises(Exception, match="equal chunks"):
        x.select(batches.chunk_of(F.col("k"), 3, 2)).collect()
    with pytest.raises(Exception, match="obs differs"):
        batches.unite(x, x.withColumn("obs", F.col("obs") + 1), "k").collect()


def test_number_partitioning():
    lengths = [4, 5, 6, 7, 8]
    parts = partitioning.differencing(lengths, 2)
    assert sorted(sum(parts, [])) == list(range(5)) and sorted(sum(lengths[i] for i in p) for p in parts) == [14, 16]
    parts = partitioning.differencing(list(range(1, 9)), 4, equal=True)
    assert {len(p) for p in parts} == {2} and {sum(range(1, 9)[i] for i in p) for p in parts} == {9}
    with pytest.raises(ValueError):
        partitioning.differencing([1, 2, 3], 2, equal=True)
    assert partitioning.greedy([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, w double")
    got = pool.resample_weighted(df, "id", F.col("w"), 5000, 1).groupBy("id").count().collect()
    share = {r.id: r["count"] / 5000 for r in got}
    assert sum(share.values()) == 1 and all(abs(share.get(i, 0) - i / 10) < 0.03 for i in range(5))


def test_boxes_and_latex():
    assert M.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\boxed{\\frac{1}{2}}" and M.last_boxed("\\boxed{1") is None
    assert M.equivalent("\\frac12", "1/2") and M.equivalent("0.5", "\\dfrac{1}{2}") and M.equivalent("x=3", "3") and M.equivalent("\\sqrt3", "\\sqrt{3}")
    assert not M.equivalent("1", "2") and M.equivalent(None, None) and not M.equivalent(None, "1")


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a.sqlite")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY, x TEXT); CREATE TABLE c (a INT, b INT REFERENCES p, PRIMARY KEY (b, a)); INSERT INTO p VALUES (1, 'u'), (2, NULL), (3, 'u')")
    db.commit()
    db.close()
    return path


def test_execution(spark, database):
    endless = "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r) SELECT count(*) FROM r"
    rows = [(database, "SELECT id FROM p"), (database, "SELECT id FROM p WHERE id > 9"), (database, "SELECT nope"), (database, " "), (database, endless), (database + "x", "SELECT 1"), (database, "DELETE FROM p")]
    got = [r.status for r in execution.execute(spark.createDataFrame(rows, "path string, sql string").coalesce(1), "path", "sql", timeout=0.5).collect()]
    assert got == ["ok", "empty_result", "error", "sql_empty", "timeout", "db_not_found", "error"]
    pairs = [("SELECT x FROM p", "SELECT DISTINCT x FROM p ORDER BY 1"), ("SELECT id, x FROM p", "SELECT x, id FROM p"), ("SELECT 1.0", "SELECT 1"), ("bad", "SELECT 1"), ("SELECT 1", "bad")]
    df = spark.createDataFrame([(database, a, b) for a, b in pairs], "path string, p string, g string").coalesce(1)
    assert [r.correct for r in execution.compare(df, "path", "p", "g").collect()] == [True, False, True, False, False]


def test_catalog_and_files(spark, database, tmp_path):
    got = {r.name: r for r in files.catalog(spark.createDataFrame([(database,)], "path string")).collect()}
    assert got["c"].primary_keys == ["b", "a"] and got["c"].foreign_keys[0].ref_column == "id" and [c.name for c in got["p"].columns] == ["id", "x"]
    (tmp_path / "a.json").write_text(json.dumps([{"sql": "a", "SQL": "b"}, {"query": "c"}]))
    rows = files.read_json_array(spark, str(tmp_path / "a.json"), "sql string, query string").orderBy("idx").collect()
    assert [(r.idx, r.sql, r["query"]) for r in rows] == [(0, "a", None), (1, None, "c")]
    assert files.read_json_lines(spark, str(tmp_path / "none"), "a int").count() == 0


def test_json_arrays_in_pieces(spark, tmp_path):
    """Braces, brackets, quotes and backslashes in strings, nesting, white space; splits of some bytes."""
    rng = random.Random(6)
    odd = ['a"b', "}{", "]", "[", "\\\\", '\\"', "é\n,", "", "}}\\", "x" * 70]
    records = [{"sql": rng.choice(odd) + rng.choice(odd), "SQL": rng.choice(odd), "n": {"a": [{"b": rng.choice(odd)}] * rng.randint(0, 2)}, "k": k} for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\ufeff " + json.dumps(records[:7], separators=(",", ":")) + "\n")
    (tmp_path / "c.json").write_text("[ ]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for name, want in (("a", records), ("b", records[:7]), ("c", [])):
            got = files.json_array_texts(spark, str(tmp_path / f"{name}.json")).orderBy("idx").collect()
            assert [r.idx for r in got] == list(range(len(want))) and [json.loads(r.text) for r in got] == want
        assert files.json_array_texts(spark, str(tmp_path)).count() == 67
        rows = files.read_json_array(spark, str(tmp_path / "a.json")).orderBy("idx").collect()
        assert [(r.sql, r["SQL"], r.k) for r in rows] == [(x["sql"], x["SQL"], x["k"]) for x in records]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rounds_of_synthesis(spark):
    def attempt(rows, k):
        return rows.withColumn("ok", F.col("id") <= k).withColumn("reason", F.lit("late"))

    done, failed = generation.in_rounds(spark.range(4), "id", attempt, 3)
    assert {(r.id, r.attempt) for r in done.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert failed.where("id = 3").count() == 3 and generation.last_attempts(failed, "id").where("id = 3").head().attempt == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(u, float(i), f"2024-01-01 00:{i:02d}:00") for i in range(10) for u in ("a", "b")], "uid string, reward double, t string")
    df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(source)
    schema = "uid string, reward double, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for name, out in (("slices", buffer.slices(stream(), "uid", "reward", 4)), ("solved", buffer.solve_counts(stream(), "ts", "1 minute", "5 minutes"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = {(r.uid, r.slice): r.vals for r in spark.table("slices").collect()}
    assert set(got) == {(u, k) for u in "ab" for k in (0, 1)} and sorted(got["a", 0] + got["a", 1]) == [float(i) for i in range(8)]
    first = {r.uid: (r.n, r.solve_none) for r in spark.table("solved").collect()}
    assert first == {"a": (5, False), "b": (5, False)}


def test_skeletons_of_all_shapes_are_stable():
    """A skeleton's skeleton is itself; queries that differ in names and literals only have one skeleton."""
    for sql, want in shapes.SHAPES:
        if want is not None:
            assert S.mask(sql.replace("#", "17").replace("@", "x y"), typed=True) == want
            assert S.mask(sql.replace("#", "9.5").replace("@", "it")) == S.mask(sql.replace("#", "3").replace("@", "z"))
    for sql, want in shapes.NORMAL:
        assert S.normalised(sql.replace("#", "17")) == want.replace("#", "17")
    assert S.attempt(S.mask, "SELECT " + "(" * 5000 + "1" + ")" * 5000)[0] is None


def test_moments_of_large_values(spark):
    rows = [(1e9 + i % 2, 1.0) for i in range(1000)] + [(-5.0, 0.0)]
    m = losses.masked_moments(spark.createDataFrame(rows, "v double, m double"), F.col("v"), F.col("m")).head()
    assert abs(m["mean"] - (1e9 + 0.5)) < 0.1 and abs(m["var"] - 0.25025) < 1e-3
    one = losses.masked_moments(spark.createDataFrame(rows[:1], "v double, m double"), F.col("v"), F.col("m")).head()
    assert one["var"] is None
    assert losses.masked_moments(spark.createDataFrame([], "v double, m double"), F.col("v"), F.col("m")).head()["var"] is None
    single = spark.createDataFrame([("u", 0, 4.0, 1.0)], "uid string, sample int, reward double, n_tokens double")
    assert rollouts.reinforce_baseline(single).head().advantage is None


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(losses, "BINS", bins)
    rng = random.Random(bins)
    x = [rng.choice([0.0, 1.0, 1e-300, -3.5, rng.gauss(0, 1e6), rng.random()]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double").cache()
    for k in (1, 2, 77, 150, 299, 300):
        assert losses.order_statistic(df, "v", k) == sorted(x)[k - 1]
    assert losses.order_statistic(df, "v", 301) is None
    near = spark.createDataFrame([(1.0,), (math.nextafter(1.0, 2),), (math.nextafter(1.0, 0),)], "v double")
    assert [losses.order_statistic(near, "v", k) for k in (1, 2, 3)] == [math.nextafter(1.0, 0), 1.0, math.nextafter(1.0, 2)]


def test_running_sums_and_places(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab") if i % 9 else None, float(rng.randint(-9, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(5).selectExpr("*", "1 AS id", "2 AS part", "3 AS __id")
    total, top = 0.0, -99.0
    got = {r.i: (r.s, r.t) for r in batches.running(batches.running(df, ["i"], F.col("v"), "s"), ["i"], F.col("v"), "t", largest=True).collect()}
    places: dict = {}
    for i, g, v in rows:
        total, top = total + v, max(top, v)
        assert got[i] == (total, top)
    for r in sorted(batches.place_in_group(df, "g", ["i"]).collect(), key=lambda r: r.i):
        assert r.place == places.get(r.g, 0)
        places[r.g] = r.place + 1
    assert batches.number(df, ["i"]).columns == [*df.columns, "k"]
    best = metrics.running_best(df.select("i", "v"), "i", "v").orderBy("i").collect()
    assert [r.best for r in best] == [got[i][1] for i in range(500)]


def test_folds(spark, monkeypatch):
    monkeypatch.setattr(A, "CELLS", 50)
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(n)], [rng.random() for _ in range(n)], [float(rng.random() > 0.3) for _ in range(n)]) for i, n in enumerate([0, 1, 5, 40, 200, 3])]
    df = spark.createDataFrame([*rows, (9, None, None, None)], "i int, r array<double>, v array<double>, m array<double>")
    got = {x.i: x for x in df.select("i", A.discounted(F.col("r"), 0.9).alias("d"), A.discounted(F.col("r"), 0.9, F.col("m")).alias("dm"), A.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("g")).collect()}
    for i, r, v, m in rows:
        d, dm, g = [0.0] * len(r), [0.0] * len(r), [0.0] * len(r)
        for t in reversed(range(len(r))):
            last = t + 1 == len(r)
            d[t] = r[t] + (0 if last else 0.9 * d[t + 1])
            dm[t] = r[t] + (0 if last else 0.9 * m[t + 1] * dm[t + 1])
            g[t] = r[t] + (0 if last else 0.9 * v[t + 1]) - v[t] + (0 if last else 0.72 * g[t + 1])
        assert np.allclose(got[i].d, d) and np.allclose(got[i].dm, dm) and np.allclose(got[i].g, g)
    assert got[9].d is None and got[9].g is None


def test_controllers_and_estimators(spark):
    kls = [0.5, 0.01, 0.1, 0.2, 0.0, 0.09]
    df = spark.createDataFrame([(i, k, 300) for i, k in enumerate(kls)], "i long, kl double, n int")
    beta, want = 0.3, []
    for k in kls:
        beta *= 1 + max(-0.2, min(0.2, k / 0.1 - 1)) * 300 / 50
        want.append(beta)
    got = rollouts.kl_controller("adaptive", df, ["i"], "kl", "n", 0.3, 0.1, 50.0).orderBy("i").collect()
    assert np.allclose([r.beta for r in got], want) and min(want) < 0
    assert {r.beta for r in rollouts.kl_controller("fixed", df, ["i"], "kl", "n", 0.3).collect()} == {0.3}
    for wrong in (lambda: rollouts.kl_controller("none", df, ["i"], "kl", "n", 0.3), lambda: rollouts.kl_controller("adaptive", df, ["i"], "kl", "n", 0.3, horizon=0), lambda: rollouts.advantage(df, "ppo"), lambda: rollouts.advantage(df, "grpo", allowed=("rloo",))):
        with pytest.raises(ValueError):
            wrong()


def test_batches_of_columns(spark, tmp_path):
    df = batches.from_columns(spark, {"a": [1, 2, 3], "b": ["x", "y", None]}, "a long, b string")
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(0, 1, "x"), (1, 2, "y"), (2, 3, None)]
    for columns in ({"a": [1], "b": []}, {"a": [1], "c": ["x"]}):
        with pytest.raises(ValueError):
            batches.from_columns(spark, columns, "a long, b string")
    arrays = spark.createDataFrame([([1, 2], [3, 4]), ([1], [])], "x array<int>, y array<int>")
    assert batches.check_lengths(arrays.limit(1), ["x", "y"]).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        batches.check_lengths(arrays, ["x", "y"]).collect()
    got = batches.collate(df, 2, ["a", "b"]).orderBy("batch").collect()
    assert [(r.n, r.a) for r in got] == [(2, [1, 2]), (1, [3])]
    batches.save(df, str(tmp_path / "b"), {"m": "1"})
    rows, meta = batches.load(spark, str(tmp_path / "b"))
    assert rows.count() == 3 and meta == {"m": "1"}
    with pytest.raises(ValueError):
        batches.pop(df, ["z"])
    with pytest.raises(ValueError):
        batches.rename(df, {"z": "y"})


def test_index(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([centres[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 16)), np.tile(centres[0], (350, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    built = index.build(df, "id", str(tmp_path / "i"), block=40)
    again = index.load(spark, built.path)
    assert np.array_equal(built.centres, again.centres)
    sizes = [len(r.ids) // 8 for r in again.blocks.collect()]
    assert sum(sizes) == len(m) and max(sizes) < 100
    asked = df.where("id % 10 = 0")
    exact = vectors.nearest(asked, df, "id", 5, same=True).cache()
    full = index.search(again, asked, "id", 5, probes=again.cells, same=True, block=16)
    key = lambda x: sorted((r.query, r.rank, r.neighbour) for r in x.collect())
    assert key(full) == key(exact)
    few = index.search(again, asked, "id", 5, same=True)
    assert index.recall(few, exact).head().recall >= 0.9
    empty = index.build(df.where("false"), "id", str(tmp_path / "e"))
    assert empty.blocks.count() == 0


def test_farthest_first_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "REFRESH", 3)
    monkeypatch.setattr(vectors, "BLOCK", 17)
    m = np.random.default_rng(3).normal(size=(80, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    rest, old = df.where("id >= 5"), df.where("id < 5")
    got = vectors.farthest_first(rest, vectors.distance_to(rest, old, "id"), "id", 10).orderBy("selection_rank").collect()
    d, chosen = 1 - (m @ m[:5].T).max(1), []
    for _ in range(10):
        d[[*range(5), *chosen]] = -1
        chosen.append(int(d.argmax()))
        d = np.minimum(d, 1 - m @ m[chosen[-1]])
    assert [r.id for r in got] == chosen


def test_generators_that_try_again():
    waits, asked = [], []

    def bad(prompts):
        asked.append("bad")
        raise OSError("down")

    def good(prompts):
        asked.append("good")
        return [p.upper() for p in prompts]

    assert generation.Retrying([bad, good], 3, 0.5, waits.append)(["a"]) == ["A"] and asked == ["bad", "good"] and waits == [0.5]
    with pytest.raises(OSError):
        generation.Retrying([bad], 3, 1.0, waits.append)(["a"])
    assert waits == [0.5, 1.0, 2.0]
    with pytest.raises(ValueError):
        generation.Retrying([], 3)
    said = iter([["{}", "no", '{"a": 1}'], ['{"a": 2}', "[1]"], ["never"]])
    got = generation.structured(lambda p: next(said), ["x", "y", "z"], lambda v: None if "a" in v else "a is missing", 3)
    assert got[0] == ({"a": 2}, None) and got[2] == ({"a": 1}, None) and got[1][0] is None and got[1][1].startswith("no JSON")


def test_errors_are_columns(spark):
    df = spark.createDataFrame([("1", "1"), ("x", "1"), (None, "1")], "a string, t string")
    got = df.select(execution.scored(lambda a, t: float(int(a) == int(t)), F.col("a"), F.col("t")).alias("s")).collect()
    assert [r.s.score for r in got] == [1.0, 0.0, 0.0] and got[0].s.error is None and got[1].s.error.startswith("ValueError")

    def failing():
        def run(prompts):
            raise OSError("down")

        return run

    said = generation.complete(df, "a", "said", failing, error="wrong").collect()
    assert all(r.said is None and r.wrong == "OSError: down" for r in said)
    with pytest.raises(ValueError):
        execution.reward("none", F.col("a"), F.col("a"), F.col("t"))
    with pytest.raises(Exception, match="no scorer for z"):
        spark.createDataFrame([("z",)], "s string").select(execution.by_source(F.col("s"), {"y": F.lit(1)})).collect()


def test_results_are_compared_in_pieces(spark, database, monkeypatch):
    monkeypatch.setattr(execution, "PIECE", 1)
    assert execution.run_sqlite(database, "SELECT x FROM p", read=execution.digest)[1] == execution.run_sqlite(database, "SELECT x FROM p ORDER BY id DESC LIMIT 2", read=execution.digest)[1]
    monkeypatch.setattr(execution, "MOST", 2)
    assert execution.run_sqlite(database, "SELECT id FROM p", read=execution.digest)[0] == "too_large"


def test_digests_tell_results_apart(database):
    def of(sql):
        return execution.run_sqlite(database, sql, read=execution.digest)[1]

    for a, b in (("SELECT -1", "SELECT -2"), ("SELECT 0", "SELECT 2305843009213693951"), ("SELECT 'a'", "SELECT x'61'"), ("VALUES (-1, 'Bob'), (5, 'x')", "VALUES (-2, 'Bob'), (5, 'x')"), ("SELECT 'a', 'bc'", "SELECT 'ab', 'c'"), ("SELECT NULL", "SELECT ''"), ("SELECT 1", "SELECT '1'"), ("SELECT 1, 1", "SELECT 1"), ("SELECT 9007199254740993", "SELECT 9007199254740992.0"), ("SELECT 'a'", "SELECT 'a' WHERE 0")):
        assert of(a) != of(b), (a, b)
    for a, b in (("SELECT 1", "SELECT 1.0"), ("VALUES (1), (2), (1)", "VALUES (2.0), (1)"), ("SELECT 1e300", "SELECT 1e300"), ("SELECT -0.0", "SELECT 0")):
        assert of(a) == of(b), (a, b)


def test_results_too_large_to_tell_are_a_state_of_their_own(database, monkeypatch):
    monkeypatch.setattr(execution, "MOST", 3)
    assert execution.run_sqlite(database, "VALUES (1), (1), (1), (1), (2)", read=execution.digest)[0] == "ok"
    assert execution.run_sqlite(database, "VALUES (1), (2), (3), (4)", read=execution.digest)[:2] == ("too_large", None)


def test_values_of_answers():
    same = [("1/2", "\\frac12"), ("0.333333", "1/3"), ("50\\%", "0.5"), ("1,234", "1234"), ("2^{10}", "1024"), ("(1, 2)", "(1,2.0)"), ("[0,\\infty)", "[0, \\infty)"), ("x+1", "1+x"), ("2x", "x*2"), ("\\sqrt{8}", "2\\sqrt{2}"), ("3\\pi", "9.42478"), ("-\\frac{3}{4}", "-0.75")]
    other = [("1", "2"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), ("x+1", "x-1"), ("abc def", "1"), ("9**9**9", "1"), ("1/0", "1"), ("", "1"), ("(1,2)", "1")]
    assert all(M.same_value(a, b) for a, b in same) and not any(M.same_value(a, b) for a, b in other)
    assert M.same_value(None, None) and not M.same_value("1", None) and not M.same_value("50", "0.5", percent=False)


def test_staging(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)
    target = files.stage(spark, source, cache)
    assert spark.read.parquet(target).count() == 5 and files.manifest(spark, source) == files.manifest(spark, target)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert files.stage(spark, source, cache) == target and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    spark.range(9).write.mode("append").parquet(source)
    assert spark.read.parquet(files.stage(spark, source, cache)).count() == 14


def test_scratch_tables_go(spark):
    with shared.scratch(spark):
        kept = shared.cut(spark.range(3))
        files_ = kept.inputFiles()
        with shared.scratch(spark):
            inner = shared.cut(spark.range(2)).inputFiles()
            result = shared.cut(spark.range(5), outside=True)
        files_ += result.inputFiles()
        assert result.count() == 5 and kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in inner)
    assert files_ and not any(os.path.exists(f.removeprefix("file://")) for f in files_)
    with shared.scratch(spark):
        stays = shared.cut(spark.range(4), outside=True)
    assert stays.count() == 4 and all(os.path.exists(f.removeprefix("file://")) for f in stays.inputFiles())


def test_threads_that_cut_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    before = spark.conf.get(shared.CLEAN, None)
    with ThreadPoolExecutor(4) as pool_:
        assert list(pool_.map(lambda n: shared.cut(spark.range(n)).count(), range(8))) == list(range(8))
    assert spark.conf.get(shared.CLEAN, None) == before and not shared._writing


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class D:
                            @staticmethod
                            def isDefined():
                                return False

                        return D

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="share"):
        shared.shared_folder(Session)


def test_whitened_values_of_every_token(spark):
    from tessera.plans import loss_queries

    d = "/root/testdata/sf0.001"
    got = loss_queries.masked_whiten(spark, d)
    assert got.columns == ["uid", "sample", "pos", "white", "shifted"]
    assert got.count() == loss_queries.tokens(spark, d).count()
