"""Staged boosted trees: chosen rounds against a replay of the saved trees in SQL."""

import itertools
import math

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.plans import staged
from riskspark.plans.training import fit_state, save_model
from tests.conftest import rows

GROUPS = {"numeric": ["TransactionAmt"], "low_cardinality": ["ProductCD"], "high_cardinality": ["card1"]}


@pytest.fixture(scope="module")
def data(spark):
    base = spark.range(1, 601).select(
        F.col("id").alias("TransactionID"), F.col("id").alias("TransactionDT"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7 % 97).cast("double")).alias("TransactionAmt"),
        F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(7))).alias("ProductCD"), (F.col("id") % 90).alias("card1"))
    noise = F.pmod(F.xxhash64("TransactionID", F.lit(5)), F.lit(10)) < 2
    return base.withColumn("isFraud", ((F.col("ProductCD").isin("p1", "p4", "p6") & (F.coalesce("TransactionAmt", F.lit(0.0)) > 30)) != noise).cast("int")).persist()


#: Average precision per round (and group) by counting, for DuckDB; ties share a point.
AP_SQL = """
, points as (select {by} round, margin, sum(y) as p, count(*) as c from long group by all),
curve as (select *, sum(p) over w as tp, sum(c) over w as n, sum(p) over (partition by {by} round) as total from points window w as (partition by {by} round order by margin desc))
select {by} round, sum(p * tp / n) / max(total) as ap from curve group by all order by all"""


def test_chosen_round_equals_a_replay_of_the_trees_in_sql(spark, data, tmp_path):
    train, valid = data.where("TransactionID <= 420"), data.where("TransactionID > 420")
    fitted = staged.train_staged(train, valid, groups=GROUPS, max_iter=8, max_depth=3, min_rows=5, patience=None)
    fitted.model.write().overwrite().save(f"{tmp_path}/model")
    vectors, names, most = staged.apply_native(valid, fitted.state)
    assert names == ["num__TransactionAmt", "num__TransactionAmt__missing", "cat__ProductCD", "freq__card1"] and most == 8
    vectors.select("TransactionID", "isFraud", vector_to_array("_features").alias("x")).write.parquet(f"{tmp_path}/x")
    con = duckdb.connect()
    con.execute(f"create view nodes as select treeID as tree, nodeData as n from '{tmp_path}/model/data/*.parquet'")
    con.execute(f"create view x as select TransactionID as id, isFraud as y, x from '{tmp_path}/x/*.parquet'")
    weights = ", ".join(f"({n}, {w})" for n, w in enumerate(fitted.model.treeWeights))
    replay = f"""
with recursive weights(tree, w) as (values {weights}),
walk as (
    select id, y, tree, 0 as node from x, weights
    union all
    select k.id, k.y, k.tree, case when case when t.n.split.numCategories > 0 then list_contains(t.n.split.leftCategoriesOrThreshold, x.x[t.n.split.featureIndex + 1])
        else x.x[t.n.split.featureIndex + 1] <= t.n.split.leftCategoriesOrThreshold[1] end then t.n.leftChild else t.n.rightChild end
    from walk k join nodes t on t.tree = k.tree and t.n.id = k.node join x on x.id = k.id where t.n.leftChild >= 0
),
leaves as (select k.id, k.y, k.tree, t.n.prediction * v.w as part from walk k join nodes t on t.tree = k.tree and t.n.id = k.node join weights v on v.tree = k.tree where t.n.leftChild < 0),
long as (select id, y, tree + 1 as round, round(sum(part) over (partition by id order by tree), 9) as margin from leaves)"""
    categorical = con.execute("select count(*) from nodes where n.leftChild >= 0 and n.split.numCategories > 0").fetchone()[0]
    assert categorical > 0  # trees split the category by sets of levels
    expected = [ap for _, ap in con.execute(replay + AP_SQL.format(by="")).fetchall()]
    margins = staged.staged_margins(vectors, fitted.model)
    rounded_margins = margins.withColumn("margins", F.transform("margins", lambda m: F.round(m, 9)))
    got = [r["average_precision"] for r in rows(staged.staged_precision(rounded_margins), "round")]
    assert got == pytest.approx(expected, abs=1e-12) and len(got) == 8
    assert fitted.rounds == max(range(8), key=lambda k: (expected[k], -k)) + 1
    # The cut model scores with its first rounds only, and the uncut margins are the model's own.
    by_id = {r["TransactionID"]: r for r in margins.collect()}
    whole = fitted.model.setRawPredictionCol("raw").transform(vectors).select("TransactionID", vector_to_array("raw")[1].alias("raw")).collect()
    assert all(r["raw"] == pytest.approx(by_id[r["TransactionID"]]["margins"][-1]) or r["raw"] == pytest.approx(2 * by_id[r["TransactionID"]]["margins"][-1]) for r in whole)
    save_model(fitted, f"{tmp_path}/saved")
    for r in staged.load(spark, f"{tmp_path}/saved").score(valid).collect():
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-2 * by_id[r["TransactionID"]]["margins"][fitted.rounds - 1])))


def test_folds_equal_sql_over_the_written_margins(spark, data, tmp_path):
    candidates = [{"name": "a", "weight_mode": "balanced", "max_depth": 2, "min_rows": 5}, {"name": "b", "weight_mode": "none", "max_depth": 3, "min_rows": 10}]
    margins = staged.staged_folds(data, groups=GROUPS, candidates=candidates, max_iter=3)
    margins.write.parquet(f"{tmp_path}/staged")
    found = rows(staged.fold_results(margins), "name", "fold")
    sql = f"""with long as (select name, fold, isFraud as y, unnest(margins) as margin, unnest(range(1, len(margins) + 1)) as round from '{tmp_path}/staged/*.parquet')"""
    curve = duckdb.sql(sql + AP_SQL.format(by="name, fold,")).fetchall()
    best = {}
    for name, fold, at, ap in curve:
        if (name, fold) not in best or ap > best[name, fold][1] + 1e-12:
            best[name, fold] = (at, ap)
    assert len(found) == 6
    for r in found:
        assert r["validation_pr_auc"] == pytest.approx(best[r["name"], r["fold"]][1]) and r["best_round"] == best[r["name"], r["fold"]][0]
    fitted = staged.refit_best(data, staged.fold_results(margins), groups=GROUPS, candidates=candidates)
    assert fitted.rounds == len(fitted.model.trees) and fitted.score(data).where("probability between 0 and 1").count() == 600


def test_best_round_and_patience():
    assert staged.best_round([0.1, 0.3, 0.3, 0.2]) == 2 and staged.best_round([0.5]) == 1
    assert staged.best_round([0.1, 0.3, 0.2, 0.2, 0.9], patience=2) == 2 and staged.best_round([0.1, 0.3, 0.2, 0.2, 0.9], patience=3) == 5


def test_unseen_levels_and_empty_vocabularies(spark, data):
    state = fit_state(data, {**GROUPS, "low_cardinality": ["ProductCD", "gone"]} if "gone" in data.columns else GROUPS)
    odd = spark.createDataFrame([(1, 1, None, "new", 5, 0), (2, 2, 3.0, None, None, 1)], "TransactionID long, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, isFraud int")
    found = [list(r["x"]) for r in rows(staged.apply_native(odd, state)[0].select("TransactionID", vector_to_array("_features").alias("x")), "TransactionID")]
    assert found[0][1] == 1.0 and found[0][2] == 0.0 and found[1][2] == 0.0 and found[1][0] == 3.0


def test_score_is_the_last_margin_without_python(spark, data):
    state = fit_state(data, GROUPS)
    model, names = staged.fit_trees(data, state, max_iter=3, max_depth=3, min_rows=5)
    fitted = staged.StagedModel("lightgbm.v2", state, model, names, 2)
    scored = fitted.score(data)
    assert "ArrowEvalPython" not in scored._jdf.queryExecution().toString()
    margins = staged.staged_margins(staged.apply_native(data, state)[0], model, 2)
    want = margins.select("TransactionID", staged.probability_of(F.element_at("margins", -1)).alias("probability"))
    assert rows(scored.select("TransactionID", "probability"), "TransactionID") == rows(want, "TransactionID")


def test_search_runs_all_rounds_of_every_fit(spark, data, monkeypatch):
    """The query leaves the number of rounds to the library, for each fold and candidate."""
    from checks import QUERIES, learning_checks

    asked, real = [], staged.fit_trees

    def short(train, state, **options):
        asked.append((options["max_iter"], options["max_depth"]))
        return real(train, state, **{**options, "max_iter": 2, "min_rows": 5})

    monkeypatch.setattr(staged, "fit_trees", short)
    monkeypatch.setattr(learning_checks, "prepared", lambda *_: data.withColumn("split", F.when(F.col("TransactionID") <= 500, "train").otherwise("test")))
    monkeypatch.setattr(learning_checks, "GROUPS", GROUPS)
    found = rows(QUERIES["search_folds"](spark, "nowhere"), "name")
    assert sorted(asked) == sorted((300, c["max_depth"]) for c in staged.BOOSTED_CANDIDATES for _ in range(3))
    assert [r["name"] for r in found] == sorted(c["name"] for c in staged.BOOSTED_CANDIDATES) and all(0 < r["mean"] <= 1 and r["std"] >= 0 for r in found)


def test_margins_from_leaves_are_the_sums_of_the_trees(spark, data):
    state = fit_state(data, GROUPS)
    model, _ = staged.fit_trees(data, state, max_iter=6, max_depth=4, min_rows=5)
    vectors = staged.apply_native(data, state)[0]
    for rounds in (None, 1, 4):
        summed, parts = staged._with_parts(vectors, model, rounds)
        expected = {r["TransactionID"]: r["parts"] for r in summed.select("TransactionID", F.array(*parts).alias("parts")).collect()}
        for r in staged.staged_margins(vectors, model, rounds).collect():
            assert r["margins"] == list(itertools.accumulate(expected[r["TransactionID"]]))
