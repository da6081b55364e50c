"""Linear models from one pass, joint boosting, as-of rows and next periods against plain versions."""

import dataclasses
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, boosting, gram, learned
from tidemark.operators import rolling as r
from tidemark.plans import learned_queries


@pytest.fixture(scope="module")
def numbers(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 3)) * [1, 50, 0.1] + [1e5, 3, 0]
    y = x @ [2.0, -0.5, 30.0] + draw.normal(size=500) * 3
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(7)


def closed(x, y, alpha):
    centred, mean = x - x.mean(axis=0), y.mean()
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - mean))
    return mean - x.mean(axis=0) @ w, w


def test_moments_and_ridge(numbers):
    x, y, df = numbers
    m = gram.moments(df, ["a", "b", "c"], "y")
    assert m.n == 500 and m.mean == pytest.approx([*x.mean(axis=0), y.mean()])
    for alpha in (0.0, 0.1, 5.0, 1000.0):
        got, (constant, weights) = gram.ridge(m, alpha), closed(x, y, alpha)
        assert got.weights == pytest.approx(weights, rel=1e-7) and got.intercept == pytest.approx(constant, rel=1e-7)
    assert gram.moments(df, ["a", "b", "c"], "y", fill=0.0).n == 501


def test_elastic_net_is_at_its_least(numbers):
    x, y, df = numbers
    m = gram.moments(df, ["a", "b", "c"], "y")
    for alpha, share in ((0.5, 0.5), (2.0, 1.0), (0.1, 0.0), (1e9, 1.0)):
        model = gram.elastic_net(m, alpha, share)
        at = lambda w: np.mean((y - x @ w - (y.mean() - x.mean(axis=0) @ w)) ** 2) / 2 + alpha * (share * abs(w).sum() + (1 - share) / 2 * (w**2).sum())
        for j in range(3):
            for step in (1e-4, -1e-4):
                moved = model.weights.copy()
                moved[j] += step
                assert at(moved) >= at(model.weights) - 1e-12
    assert not gram.elastic_net(m, 1e9, 1.0).weights.any()


def test_sweep_takes_one_pass(spark, numbers):
    x, y, df = numbers
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("moments", "one pass for all penalties")
    m = gram.moments(df, ["a", "b", "c"], "y")
    jobs = len(tracker.getJobIdsForGroup("moments"))
    spark.sparkContext.setJobGroup("sweep", "")
    got = {row.alpha: row.mae for row in gram.sweep(df, df, ["a", "b", "c"], "y", [0.1, 1.0, 10.0, 100.0]).collect()}
    assert len(tracker.getJobIdsForGroup("sweep")) <= jobs + 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for alpha, mae in got.items():
        constant, w = closed(x, y, alpha)
        assert mae == pytest.approx(np.abs(y - constant - x @ w).mean(), rel=1e-9)
    assert m.n == 500 and [row.alpha for row in learned.alpha_sweep(df, df, ["a", "b", "c"], "y", [10.0, 0.1]).collect()] == sorted([10.0, 0.1], key=got.get)


def test_no_rows(numbers):
    m = gram.moments(numbers[2].where("false"), ["a", "b"], "y")
    assert m.n == 0 and gram.ridge(m, 1.0).intercept == 0 and not gram.elastic_net(m, 0.1, 0.5).weights.any()


# Boosting


class PlainBoosting:
    """The same trees by loops over rows."""

    def __init__(self, model, growth):
        self.m, self.growth = model, growth

    def bins(self, row):
        return [0 if v is None else sum(e < v for e in edges) + 1 for v, edges in zip(row, self.m.edges)]

    def chances(self, f):
        top = max(f)
        e = [math.exp(v - top) for v in f]
        return [v / sum(e) for v in e]

    def best(self, rows):
        """(gain, feature, bin, left rows, right rows)"""
        found, whole = None, self.value(rows)
        for j in range(len(self.m.features)):
            for b in range(max(len(e) for e in self.m.edges) + 1):
                left, right = [x for x in rows if x[0][j] <= b], [x for x in rows if x[0][j] > b]
                if min(len(left), len(right)) < self.growth.rows:
                    continue
                gain = self.value(left) + self.value(right) - whole
                if gain > self.growth.gain and (found is None or gain > found[0] * (1 + 1e-9)):
                    found = (gain, j, b, left, right)
        return found

    def value(self, rows):
        g, h = sum(x[1] for x in rows), sum(x[2] for x in rows)
        return g * g / (h + self.growth.penalty)

    def fit(self, data, rounds):
        rows = [(self.bins(x), k) for x, k in data]
        margin = [list(self.m.prior) for _ in rows]
        for _ in range(rounds):
            steps = []
            for k in range(len(self.m.classes)):
                leaf = []
                for i, ((b, label), f) in enumerate(zip(rows, margin)):
                    p = self.chances(f)[k]
                    leaf.append((b, p - (label == k), p * (1 - p), i))
                leaves = [leaf]
                while len(leaves) < self.growth.leaves:
                    ready = [(s[0], -n, s) for n, s in enumerate(map(self.best, leaves)) if s]
                    if not ready:
                        break
                    _, n, s = max(ready, key=lambda x: x[0])
                    leaves[-n : -n + 1] = [s[3], s[4]]
                steps.append([(x[3], 0.0 if len(leaves) == 1 else -self.growth.rate * sum(y[1] for y in part) / (sum(y[2] for y in part) + self.growth.penalty)) for part in leaves for x in part])
            for k, each in enumerate(steps):
                for i, v in each:
                    margin[i][k] += v
        return [self.chances(f) for f in margin]


@pytest.mark.parametrize("growth", [boosting.Growth(rate=0.3, leaves=4, rows=5), boosting.Growth(rate=0.5, leaves=7, rows=3, penalty=1.0)])
def test_boosting_equals_a_plain_version(spark, growth):
    draw = random.Random(6)
    data = []
    for _ in range(160):
        a, b = draw.gauss(0, 1), draw.choice([0.0, 1.0, 2.0, None])
        z = a + (b or -1) + draw.gauss(0, 0.5)
        data.append(((a, b), "H" if z > 1 else "A" if z < 0 else "D"))
    df = spark.createDataFrame([(i, *x, k) for i, (x, k) in enumerate(data)], "i long, a double, b double, label string").repartition(5)
    model = boosting.fit(df.unionByName(df.limit(3).withColumn("label", F.lit("?"))), ["a", "b"], "label", ["A", "D", "H"], rounds=5, growth=growth, bins=8)
    plain = PlainBoosting(model, growth).fit([(x, "ADH".index(k)) for x, k in data], 5)
    got = {x.i: x for x in boosting.scored(df, model).collect()}
    for i, want in enumerate(plain):
        assert [got[i].p_A, got[i].p_D, got[i].p_H] == pytest.approx(want, abs=1e-9)
        assert sum(want) == pytest.approx(1) and got[i].pred == "ADH"[want.index(max(want))]
    assert all(1 < sum(f < 0 for f in t.feature) <= growth.leaves for trees in model.rounds for t in trees)


def test_boosting_goes_through_different_rows_alone(spark, monkeypatch):
    """Trees were grown over every row again and again; rows of the same bins and class are one with a weight."""
    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 < 3, F.col("id") % 3).cast("double").alias("b"), F.when(F.col("id") % 7 + F.col("id") % 11 > 8, "H").otherwise("A").alias("label"))
    gone, grow = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, *how: gone.append((rows.count(), rows.rdd.getNumPartitions())) or grow(rows, *how))
    model = boosting.fit(df, ["a", "b"], "label", ["A", "H"], rounds=2, growth=boosting.Growth(leaves=3, rows=50))
    assert gone == [(df.distinct().count(), 1)] * 2 and all(n < 60 for n, _ in gone)
    once = boosting.scored(df.distinct(), model).select("a", "b", "p_A", "p_H").distinct()
    share = df.agg(F.avg((F.col("label") == "A").cast("double"))).first()[0]
    assert once.count() == df.select("a", "b").distinct().count() and df.join(once, (df.a == once.a) & df.b.eqNullSafe(once.b)).agg(F.avg("p_A")).first()[0] == pytest.approx(share, abs=0.01)


def test_boosting_of_few_rows_is_a_job_a_round(spark, monkeypatch):
    """Every step of a round was a job and went through all trees before; the trees are those of rows dealt over tasks, whenever the scores are kept."""
    df = spark.range(3000).select("id", (F.col("id") * 7 % 19).cast("double").alias("a"), (F.col("id") * 5 % 13).cast("double").alias("b")).withColumn("label", F.when((F.col("a") * F.col("b") + F.col("id") % 11) % 7 > 3, "H").when(F.col("a") > F.col("b"), "D").otherwise("A")).cache()
    jobs, histograms = [], boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *how: jobs.append(len(how[1].rounds)) or histograms(*how))
    fit = lambda: boosting.fit(df, ["a", "b"], "label", learned.OUTCOMES, rounds=5, growth=boosting.Growth(rate=0.3, leaves=5, rows=10, penalty=1.0))
    alone = fit()
    assert not jobs
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 200)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    dealt = fit()
    assert set(jobs) == {0, 1}  # no job goes through more than the trees since the last kept scores
    shape = lambda m: [[(t.feature, t.bin, t.left) for t in trees] for trees in m.rounds]
    assert len(alone.rounds) == 5 and shape(alone) == shape(dealt)
    assert [v for trees in alone.rounds for t in trees for v in t.value] == pytest.approx([v for trees in dealt.rounds for t in trees for v in t.value], abs=1e-9)
    bins = np.array([[i, j] for i in range(20) for j in range(14)])
    assert alone.chances(bins) == pytest.approx(dealt.chances(bins), abs=1e-9)


def test_leafwise_outcomes_take_every_round(spark, monkeypatch):
    """Four rounds were fitted of the original's 200."""
    models, scored = [], boosting.scored
    monkeypatch.setattr(boosting, "scored", lambda df, model: models.append(model) or scored(df, model))
    rows = learned_queries.outcome_leafwise(spark, "/root/testdata/sf0.001").collect()
    (model,) = models
    sizes = [[sum(f < 0 for f in t.feature) for t in trees] for trees in model.rounds]
    assert len(sizes) == 200 and all(1 < n <= 15 for trees in sizes for n in trees) and max(map(max, sizes)) == 15
    train, valid = learned_queries._matches(spark, "/root/testdata/sf0.001")
    assert len(rows) == valid.count() and all(abs(x.p_home + x.p_draw + x.p_away - 1) < 3e-6 for x in rows)
    known = train.select(*learned_queries.MATCH_FEATURES, "label").toPandas()
    bins, place = model.bins(known[learned_queries.MATCH_FEATURES].to_numpy()), known.label.map(learned.OUTCOMES.index).to_numpy()
    loss = lambda m: -np.log(m.chances(bins)[np.arange(len(place)), place]).mean()
    assert loss(model) < loss(dataclasses.replace(model, rounds=model.rounds[:100])) < loss(dataclasses.replace(model, rounds=model.rounds[:4]))


def test_boosting_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, label string")
    model = boosting.fit(empty, ["a"], "label", ["A", "H"], rounds=2)
    got = boosting.scored(spark.createDataFrame([(None, "x"), (1.0, "y")], "a double, p_ string"), model).collect()
    assert all((x.p_A, x.p_H, x.pred) == (0.5, 0.5, "A") for x in got)


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows of few different values: features, goals and a label that follow them."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 12, size=(9000, 2)) / 5
    goals = draw.poisson(0.4 + x).astype(float)
    rows = [(*map(float, a), float(a[0] - a[1]), *map(float, g), "H" if g[0] > g[1] else "A" if g[0] < g[1] else "D") for a, g in zip(x, goals)]
    return spark.createDataFrame(rows, "a double, b double, c double, home double, away double, label string").cache()


def test_a_weight_stands_for_rows(spark, repeated):
    """Logistic regression and boosted trees of different rows with weights, against those of all rows, fewest rows of a leaf included."""
    features = ["a", "b", "c"]
    few = learned.collapsed(repeated, [*features, "label"])
    assert few.agg(F.sum("weight")).first()[0] == 9000 and few.count() == repeated.select(*features, "label").distinct().count() < 500
    asked = repeated.select(*features).distinct()
    chances = lambda rows, **how: sorted(learned.outcome_chances(learned.outcome_logistic(rows, features, "label", **how), asked, features).select("a", "b", "p_home", "p_draw", "p_away").collect())
    for got, want in zip(chances(few, weight="weight"), chances(repeated)):
        assert list(got) == pytest.approx(list(want), abs=1e-5)
    for leaf in (20, 1500, 5000):
        values = lambda rows, **how: sorted(learned.boosted(rows, features, "home", rounds=3, leaf=leaf, **how).transform(asked).select("a", "b", "prediction").collect())
        got, want = values(learned.collapsed(repeated, [*features, "home"]), weight="weight"), values(repeated)
        assert [list(x) for x in got] == [pytest.approx(list(x), abs=1e-9) for x in want]


def test_goal_models_do_not_depend_on_how_rows_are_dealt(repeated):
    """The edges of features came from a sample of 10,000 rows, which differed with the tasks; and every row was gone through for each level of each tree."""
    features = ["a", "b", "c"]
    rows = repeated.union(repeated.where("home < 2")).union(repeated.where("away > 0"))
    asked = repeated.select(*features).distinct()
    found = [[sorted(m.transform(asked).select("a", "b", F.round("prediction", 6)).collect()) for m in learned.goal_models(rows.repartition(n), features, "home", "away")] for n in (3, 7)]
    assert found[0] == found[1]


def test_repeats_take_the_steps_of_all_rows(spark, repeated):
    """A fit that ends before it is there came out otherwise with weights (by up to 0.009 for m11 on 60 x sf0.1); repeats give what all rows give."""
    features = ["a", "b", "c"]
    rows = repeated.select("label", *features).withColumns({"id": F.monotonically_increasing_id(), "period": F.when(F.col("a") > 2, 71).otherwise(F.col("b").cast("int"))})
    few, late = learned.split_collapsed(rows.union(rows.where("period = 71").limit(1)).union(rows.limit(1).withColumn("period", F.lit(None))), ["id"], "period", 70, ["label", *features])
    early, want = learned.temporal_split(rows, "period", 70)
    assert few.agg(F.sum("weight")).first()[0] == early.count() and few.count() == early.select("label", *features).distinct().count() < 500
    assert late.count() == want.count() + 1 and late.select(*want.columns[:-2], "id").distinct().exceptAll(want.drop("period")).isEmpty() and late.columns == ["id", "label", *features]
    fit = lambda train, **how: learned.outcome_logistic(train, features, "label", rounds=4, **how).stages[-1]
    got, all_rows = fit(few, repeats="weight"), fit(early)
    assert got.summary.totalIterations == all_rows.summary.totalIterations == 4
    assert got.summary.objectiveHistory == pytest.approx(all_rows.summary.objectiveHistory, rel=1e-12)
    assert got.coefficientMatrix.toArray() == pytest.approx(all_rows.coefficientMatrix.toArray(), rel=1e-9)


def test_full_logistic_holds_different_rows_alone(spark, monkeypatch):
    """The fit held every early match with all its features, and assembled each of them anew for every pass that needed it."""
    base = learned_queries.feature_queries.match_features(spark, "/root/testdata/sf0.001").cache()
    copies = base.crossJoin(spark.range(5)).withColumn("match_id", F.col("match_id") + F.col("id") * 100_000).drop("id")
    monkeypatch.setattr(learned_queries.feature_queries, "match_features", lambda *_: copies)
    seen, fit = [], learned.outcome_logistic
    monkeypatch.setattr(learned, "outcome_logistic", lambda rows, *how, **more: seen.append(rows.count()) or fit(rows, *how, **more))
    got = learned_queries.outcome_logistic_v2(spark, "")
    assert seen[0] <= base.where("period <= 70").count()
    late = copies.where("period > 70").select("match_id")
    assert got.count() == late.count() and got.select("match_id").exceptAll(late).isEmpty()


# As of


def test_attach(spark):
    draw = random.Random(2)
    history = [(draw.choice(["x", "y", None]), draw.choice([None, *range(20)]), draw.choice([None, 1, 2]), draw.randrange(5)) for _ in range(120)]
    probes = [(draw.choice(["x", "y", "z", None]), draw.choice([None, *range(22)]), i // 2) for i in range(80)]
    past, asks = spark.createDataFrame(history, "e string, t int, a int, b int"), spark.createDataFrame(probes, "e string, t int, id int")
    for inclusive in (False, True):
        want = []
        for e, t, i in probes:
            before = [h for h in history if e is not None and t is not None and h[0] == e and h[1] is not None and (h[1] < t or inclusive and h[1] == t)]
            last = max(before, key=lambda h: (h[1], h[2] is not None, h[2] or 0, h[3]), default=(None,) * 4)
            want.append((e, t, i, last[2], last[3]))
        got = asof.attach(asks, past, ["e"], "t", ["a", "b"], inclusive)
        assert got.columns == ["e", "t", "id", "a", "b"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_next_period_sees_all_its_past_and_nothing_later(spark):
    draw = random.Random(4)
    rows = [(e, p, draw.randrange(9), draw.choice([None, 5 + p])) for e in range(8) for p in sorted(draw.sample(range(1, 15), 6))]
    df = spark.createDataFrame(rows, "e long, p int, x long, price int")
    own = defaultdict(list)
    for e, p, x, price in rows:
        own[e].append((p, x, price))
    for target in (None, 10):
        frame = r.rolling_form(asof.next_period(df, ["e"], "p", ["price"], target), ["e"], ["p"], ["x"]).where("is_next")
        got = {q.e: (q.p, q.x_last1, q.x_mean3, q.price) for q in frame.collect()}
        want = {}
        for e, seen in own.items():
            past = [s for s in seen if target is None or s[0] < target]
            if past:
                tail = [x for _, x, _ in past[-3:]]
                want[e] = (target or past[-1][0] + 1, past[-1][1], pytest.approx(sum(tail) / len(tail)), next((c for _, _, c in reversed(past) if c is not None), None))
        assert got == want


def test_log_loss_of_joint_boosting(spark):
    """Matches whose goals follow the sides' strengths, on later matches: far below that of the shares, and as low as with one two-way model for each outcome, its chances divided by their sum (whose first tree counts ten times)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    draw, features = np.random.default_rng(8), ["home", "away", "diff"]
    strength = draw.normal(size=(3000, 2))
    goals = draw.poisson(np.exp(0.3 + 0.5 * (strength - strength[:, ::-1])))
    rows = [(i, float(h), float(a), float(h - a), "H" if x > y else "A" if x < y else "D") for i, ((h, a), (x, y)) in enumerate(zip(strength, goals.tolist()))]
    df = spark.createDataFrame(rows, "i long, home double, away double, diff double, label string").cache()
    train, valid = learned.temporal_split(df, "i", 2000)
    joint = boosting.scored(valid, boosting.fit(train, features, "label", learned.OUTCOMES, rounds=15, growth=boosting.Growth(rate=0.1, leaves=4)))
    chance = lambda: F.when(F.col("label") == "H", F.col("p_H")).when(F.col("label") == "D", F.col("p_D")).otherwise(F.col("p_A"))
    assert joint.where("abs(p_H + p_D + p_A - 1) > 1e-12").isEmpty()
    ours = joint.agg(F.avg(-F.log(chance()))).first()[0]
    vectors = VectorAssembler(inputCols=features, outputCol="features")
    single = vectors.transform(valid)
    for k in learned.OUTCOMES:
        model = GBTClassifier(maxIter=15, maxDepth=2, stepSize=0.1, labelCol="y").fit(vectors.transform(train.withColumn("y", (F.col("label") == k).cast("double"))))
        single = model.transform(single).withColumn(f"p_{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    total = F.col("p_H") + F.col("p_D") + F.col("p_A")
    shares = train.groupBy("label").count().withColumn("p", F.col("count") / train.count())
    assert ours < single.agg(F.avg(-F.log(chance() / total))).first()[0] + 0.005
    assert ours < valid.join(shares, "label").agg(F.avg(-F.log("p"))).first()[0] - 0.05
