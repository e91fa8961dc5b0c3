"""Training, scoring and explanation; model fits have no SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.registry import query, rounded, txn_sql
from riskspark.operators import reference_state, sampling
from riskspark.operators.evaluation import cv_summary
from riskspark.operators.history import KeyHistory, source_columns, with_history
from riskspark.functions.row_features import with_v2_row_features
from riskspark.plans import batch, network, scoring, staged, training, tree_contributions
from riskspark.session import write_through
from riskspark.sources.demo_tables import txn

GROUPS = {
    "numeric": ["TransactionAmt", "D1", "D2", "transaction_amount_cents", "card1_key_prior_count", "uid_proxy_prior_count", "num_missing"],
    "low_cardinality": ["ProductCD", "P_emaildomain", "DeviceInfo", "addr1"],
    "high_cardinality": ["card1", "id_31"],
}
INPUTS = [c for columns in GROUPS.values() for c in columns]


def prepared(spark, sf_dir):
    """Features with their split, written once because training reads them many times."""
    specs = [KeyHistory("card1_key"), KeyHistory("uid_proxy")]
    rows = with_v2_row_features(txn(spark, sf_dir))
    wanted = [c for c in rows.columns if c in {"isFraud", *INPUTS, *source_columns(specs, rows.columns)}]
    rows = with_history(rows.select(*wanted), specs)  # columns that nobody reads are not written
    narrow = write_through(rows.select("TransactionID", "TransactionDT", "isFraud", *INPUTS), "training-rows")  # the split reads them three times
    return sampling.split_chronological(narrow)


def split(rows, name):
    return rows.where(F.col("split") == name).drop("split")


def facts(fitted, rows, name):
    """What must hold for any fit: all test rows scored once, scores in [0, 1], and more learnt from the training rows than their base rate."""
    scored = fitted.score(split(rows, "test"))
    train = split(rows, "train")
    precision = training.average_precision(fitted.score(train))
    base = train.agg(F.avg("isFraud")).first()[0]
    outside = F.col("probability").isNull() | F.isnan("probability") | (F.col("probability") < 0) | (F.col("probability") > 1)
    return scored.agg(
        F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows_scored"), F.countDistinct("TransactionID").alias("ids_scored"),
        F.count_if(outside).alias("outside"), F.sum("isFraud").cast("bigint").alias("positives"), F.lit(precision > base).alias("better_than_base_rate"))


def facts_sql(name):
    """The latest 15 percent of the rows, whose scores may be anything but missing or outside."""
    return txn_sql(f"""
select '{name}' as model, count(*) as rows_scored, count(distinct TransactionID) as ids_scored, 0::bigint as outside, sum(isFraud)::bigint as positives,
  true as better_than_base_rate
from placed where place >= cast(floor(n * (0.70::double + 0.15::double)) as bigint)""", PLACED)


PLACED = "placed as (select *, row_number() over (order by TransactionDT, TransactionID) - 1 as place, count(*) over () as n from txn)"


@query("train_logistic", facts_sql("logistic_regression"))
def _logistic(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return facts(training.train_logistic(split(rows, "train"), groups=GROUPS), rows, "logistic_regression")


@query("train_boosted", facts_sql("boosted"))
def _boosted(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return facts(staged.train_staged(split(rows, "train"), split(rows, "validation"), groups=GROUPS, max_iter=20), rows, "boosted")


@query("train_network", facts_sql("network"))
def _network(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    fitted = network.train_network(split(rows, "train"), split(rows, "validation"), groups=GROUPS, hidden=(32, 16), dropout=(), epochs=6, batches=8, rate=0.02)
    return facts(fitted, rows, "network")


@query("search_folds")
def _folds(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    development = rows.where("split <> 'test'").drop("split")
    return cv_summary(staged.fold_results(staged.staged_folds(development, groups=GROUPS)))


@query("search_weight_mode")
def _mode(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return network.search_weight_mode(split(rows, "train"), split(rows, "validation"), groups=GROUPS, hidden=(32, 16), dropout=(), epochs=6, batches=8, rate=0.02)


# Models of fixed coefficients, which SQL can state.
FIRST = {"TransactionAmt": 0.0131, "D1": -0.0271, "D2": 0.0519}
SECOND = {"card1": 0.00117, "addr1": 0.413, "TransactionAmt": 0.00713}
SCORERS = {"logistic_regression.v2": scoring.LinearScorer(FIRST, -1.7), "lightgbm.v2": scoring.LinearScorer(SECOND, -0.9)}


def z_sql(scorer, without=None):
    return " + ".join([f"({scorer.intercept}::double)", *[f"{w}::double * coalesce({c}::double, 0)" for c, w in scorer.coefficients.items() if c != without]])


def p_sql(scorer, without=None):
    return f"1.0 / (1.0 + exp(-({z_sql(scorer, without)})))"


@query("score_models", txn_sql(" union all ".join(
    f"select TransactionID, '{name}' as model_identifier, round({p_sql(m)}, 9) + 0.0 as risk_score from txn" for name, m in SCORERS.items())))
def _score(spark, sf_dir):
    found = scoring.score_models(txn(spark, sf_dir), SCORERS)
    return found.select("TransactionID", "model_identifier", rounded("risk_score"))


def _toy_model():
    return lambda frame: 1.0 / (1.0 + (frame["TransactionAmt"].fillna(0) - 50).abs() / 10)


@query("score_external_model", txn_sql("""
select TransactionID, 'catboost.v2' as model_identifier, 1.0 / (1.0 + abs(coalesce(TransactionAmt, 0) - 50) / 10) as risk_score from txn"""))
def _external(spark, sf_dir):
    return scoring.score_external_model(txn(spark, sf_dir), "catboost.v2", _toy_model, ["TransactionAmt", "card1"])


@query("feature_importance")
def _importance(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return training.feature_importance(training.train_logistic(split(rows, "train"), groups=GROUPS))


HIDDEN = "hidden as (" + " union all ".join(
    f"select TransactionID, '{c}' as feature, {p_sql(SCORERS['lightgbm.v2'])} - {p_sql(SCORERS['lightgbm.v2'], c)} as contribution from txn where {c} is not null" for c in SECOND) + ")"


@query("explain_ablation", txn_sql("""
select TransactionID, feature, round(contribution, 9) + 0.0 as contribution, row_number() over (partition by TransactionID order by abs(round(contribution, 9)) desc, feature) as rank,
  case when round(contribution, 9) >= 0 then 'toward_fraud' else 'toward_not_fraud' end as direction from hidden""", HIDDEN))
def _ablation(spark, sf_dir):
    found = scoring.explain_ablation(txn(spark, sf_dir), SCORERS["lightgbm.v2"], list(SECOND))
    return found.select("TransactionID", "feature", rounded("contribution"), F.col("rank").cast("bigint").alias("rank"), "direction")


@query("explain_trees", txn_sql("""
select count(*) as rows_explained, 0::bigint as not_additive
from placed where place >= cast(floor(n * (0.70::double + 0.15::double)) as bigint)""", PLACED))
def _trees(spark, sf_dir):
    """Contributions of all test rows, added up against their margins: no row may differ."""
    rows = prepared(spark, sf_dir)
    fitted = staged.train_staged(split(rows, "train"), split(rows, "validation"), groups=GROUPS, max_iter=5, max_depth=4)
    leaf, test = tree_contributions.leaves(fitted), split(rows, "test")
    margins = staged.last_margin(staged.apply_native(test, fitted.state)[0], fitted.model, fitted.rounds)
    expected = margins.select("TransactionID", (F.col("margin") - tree_contributions.base(leaf)).alias("expected"))
    sums = tree_contributions.contributions(test, fitted, leaf).groupBy("TransactionID").agg(F.sum("contribution").alias("total"))
    off = F.abs(F.coalesce("total", F.lit(0.0)) - F.coalesce("expected", F.lit(float("inf")))) > 1e-9
    return expected.join(sums, "TransactionID", "left").agg(F.count(F.lit(1)).alias("rows_explained"), F.count_if(off).alias("not_additive"))


CUT = 22 * 86_400
LATER = scoring.LinearScorer({"TransactionAmt": 0.0131, "card1_key_prior_count": 0.0213}, -1.1)
EARLY = scoring.LinearScorer({"TransactionAmt": 0.0131, "has_identity": 0.771}, -1.3)


def raw_batch(spark, sf_dir):
    """All rows, early ones included, some with a negative amount and some twice."""
    rows = txn(spark, sf_dir).drop("probability", "probability_b", "k")
    changed = rows.withColumn("TransactionAmt", F.when(F.col("TransactionID") % 50 == 0, -1.0).otherwise(F.col("TransactionAmt")))
    return changed.unionByName(changed.where("TransactionID % 40 = 1"))


@query("batch_scoring", txn_sql(f"""
select TransactionID, m as model_identifier, round(p, 9) + 0.0 as risk_score, threshold, p >= threshold as decision from (
  select TransactionID, 'logistic_regression.v1' as m, 0.45 as threshold, {p_sql(EARLY)} as p
  from (select *, cast(coalesce(DeviceType, DeviceInfo, id_30, id_31) is not null as int) as has_identity from valid)
  union all
  select TransactionID, 'lightgbm.v2', 0.55, {p_sql(LATER)} from (select v.*, coalesce(s.n, 0) as card1_key_prior_count from valid v left join seen s using (card1)))""",
    f"valid as (select * from txn where TransactionDT >= {CUT} and TransactionID % 50 <> 0 and TransactionID % 40 <> 1)",
    f"seen as (select card1, count(*) as n from txn where TransactionDT < {CUT} group by card1)"))
def _batch(spark, sf_dir):
    history = txn(spark, sf_dir).where(f"TransactionDT < {CUT}")
    state = reference_state.build(history, [KeyHistory("card1_key")])
    models = [batch.BatchModel("logistic_regression.v1", "v1", EARLY.score, 0.45), batch.BatchModel("lightgbm.v2", "v2", LATER.score, 0.55)]
    found = batch.score_batch(raw_batch(spark, sf_dir), models, state=state).predictions
    return found.select("TransactionID", "model_identifier", rounded("risk_score"), "threshold", "decision")
