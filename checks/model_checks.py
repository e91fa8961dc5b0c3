"""Encoders and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded, r, txn_sql
from checks.table_checks import SPLIT_SQL
from riskspark.operators import encoders, evaluation, ordering
from riskspark.session import write_through
from riskspark.sources.demo_tables import txn

CUT = 86_400 * 22  # training rows end here in the encoder checks


def parts(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return rows.where(f"TransactionDT < {CUT}"), rows.where(f"TransactionDT >= {CUT}")


def level_cte(column):
    return f"""lv_{column} as (select coalesce(cast({column} as varchar), 'MISSING') as v, count(*) as n,
      count(*) / sum(count(*)) over () as share from txn where TransactionDT < {CUT} group by 1)"""


def joined(columns):
    return " ".join(f"left join lv_{c} on lv_{c}.v = coalesce(cast(t.{c} as varchar), 'MISSING')" for c in columns)


FREQ = ["card1", "P_emaildomain", "id_31"]


@query("enc_frequency", txn_sql("select t.TransactionID, " + ", ".join(
    r(f"coalesce(lv_{c}.share, 0)", f"{c}__frequency") for c in FREQ) + f" from txn t {joined(FREQ)} where TransactionDT >= {CUT}", *map(level_cte, FREQ)))
def _frequency(spark, sf_dir):
    train, rest = parts(spark, sf_dir)
    encoded = encoders.apply_frequency(rest, encoders.fit_levels(train, FREQ), FREQ)
    return encoded.select("TransactionID", *[rounded(f"{c}__frequency") for c in FREQ])


LOW = ["ProductCD", "P_emaildomain", "DeviceInfo", "addr1"]
RARE = 1300  # high enough to leave rare levels in the small tables


@query("enc_rare_levels", txn_sql("select t.TransactionID, " + ", ".join(
    f"case when lv_{c}.v is null then 'UNKNOWN' when lv_{c}.n >= {RARE} or lv_{c}.v = 'MISSING' then lv_{c}.v else 'OTHER' end as {c}" for c in LOW)
    + f" from txn t {joined(LOW)}", *map(level_cte, LOW)))
def _rare(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    levels = encoders.fit_levels(train, LOW, rare_min_count=RARE)
    return encoders.apply_rare_levels(txn(spark, sf_dir), levels, LOW).select("TransactionID", *LOW)


@query("enc_levels_once", txn_sql("select t.TransactionID, " + ", ".join(
    [r(f"coalesce(lv_{c}.share, 0)", f"{c}__frequency") for c in FREQ] + [
        f"case when lv_{c}.v is null then 'UNKNOWN' when lv_{c}.n >= {RARE} or lv_{c}.v = 'MISSING' then lv_{c}.v else 'OTHER' end as {c}" for c in LOW])
    + f" from txn t {joined(dict.fromkeys(FREQ + LOW))}", *map(level_cte, dict.fromkeys(FREQ + LOW))))
def _once(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    levels = encoders.fit_levels(train, list(dict.fromkeys(FREQ + LOW)), rare_min_count=RARE)
    encoded = encoders.apply_levels_once(txn(spark, sf_dir), levels, frequency=FREQ, rare=LOW)
    return encoded.select("TransactionID", *[rounded(f"{c}__frequency") for c in FREQ], *LOW)


VOCAB = ["ProductCD", "id_31", "card1"]


@query("enc_vocabulary", txn_sql("select t.TransactionID, " + ", ".join(
    f"case when coalesce(cast(t.{c} as varchar), 'MISSING') = 'MISSING' then 0 when vo_{c}.i is not null then vo_{c}.i when lv_{c}.v is not null then 2 else 1 end as {c}__index" for c in VOCAB)
    + f" from txn t {joined(VOCAB)} " + " ".join(f"left join vo_{c} on vo_{c}.v = coalesce(cast(t.{c} as varchar), 'MISSING')" for c in VOCAB),
    *map(level_cte, VOCAB), *[f"vo_{c} as (select v, row_number() over (order by v) + 2 as i from lv_{c} where n >= 20 and v not in ('MISSING', 'UNKNOWN', 'OTHER'))" for c in VOCAB]))
def _vocabulary(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    levels = encoders.fit_levels(train, VOCAB)
    encoded = encoders.apply_vocabulary(txn(spark, sf_dir), encoders.fit_vocabulary(levels), VOCAB)
    return encoded.select("TransactionID", *[F.col(f"{c}__index").cast("bigint").alias(f"{c}__index") for c in VOCAB])


SCALED = ["TransactionAmt", "D1", "D4", "addr2"]


@query("enc_median_scale", txn_sql("select TransactionID, " + ", ".join(
    f"{r(f'(coalesce(cast({c} as double), m_{c}) - a_{c}) / s_{c}', f'{c}__scaled')}, cast({c} is null as double) as {c}__missing" for c in SCALED) + " from txn, fit",
    "med as (select " + ", ".join(f"median(cast({c} as double)) as m_{c}" for c in SCALED) + f" from txn where TransactionDT < {CUT})",
    "fit as (select " + ", ".join(f"max(m_{c}) as m_{c}, avg(coalesce({c}, m_{c})) as a_{c}, stddev_samp(coalesce({c}, m_{c})) as s_{c}" for c in SCALED)
    + f" from txn, med where TransactionDT < {CUT})"))
def _scale(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    encoded = encoders.apply_scaling(txn(spark, sf_dir), encoders.fit_scaling(train, SCALED), SCALED)
    return encoded.select("TransactionID", *[rounded(f"{c}__scaled") for c in SCALED], *[f"{c}__missing" for c in SCALED])


GROUPS = {"numeric": ["TransactionAmt", "D1"], "low_cardinality": ["ProductCD", "addr1"], "high_cardinality": ["card1"]}


@query("enc_passthrough", txn_sql("""select TransactionAmt, D1, coalesce(ProductCD, 'MISSING') as ProductCD,
  coalesce(cast(addr1 as varchar), 'MISSING') as addr1, coalesce(cast(card1 as varchar), 'MISSING') as card1 from txn"""))
def _passthrough(spark, sf_dir):
    return encoders.passthrough(txn(spark, sf_dir), GROUPS)


@query("enc_linear", txn_sql(f"""
select TransactionID, {r('coalesce(TransactionAmt, m_a) / s_a', 'amount')}, {r('coalesce(D1, m_d) / s_d', 'd1')}, {r('cast(D1 is null as double) / s_m', 'd1_missing')},
  cast(ProductCD = 'click' as double) as click, cast(coalesce(cast(addr1 as varchar), 'MISSING') = 'MISSING' as double) as addr1_missing,
  {r('coalesce(lv_card1.share, 0) / s_f', 'card1_frequency')}
from txn t {joined(['card1'])}, fit, freq""", level_cte("card1"),
    f"med as (select median(TransactionAmt) as m_a, median(D1) as m_d from txn where TransactionDT < {CUT})",
    f"fit as (select max(m_a) as m_a, max(m_d) as m_d, stddev_pop(coalesce(TransactionAmt, m_a)) as s_a, stddev_pop(coalesce(D1, m_d)) as s_d, stddev_pop(cast(D1 is null as double)) as s_m from txn, med where TransactionDT < {CUT})",
    f"freq as (select stddev_pop(lv_card1.share) as s_f from txn t {joined(['card1'])} where TransactionDT < {CUT})"))
def _linear(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    encoded, names = encoders.apply_linear(txn(spark, sf_dir), encoders.fit_linear(train, GROUPS))
    at = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    shown = {"amount": "num__TransactionAmt", "d1": "num__D1", "d1_missing": "num__D1__missing", "click": "cat__ProductCD__click",
             "addr1_missing": "cat__addr1__MISSING", "card1_frequency": "freq__card1"}
    return encoded.select("TransactionID", *[rounded(at[full]).alias(short) for short, full in shown.items()])


# --- evaluation -----------------------------------------------------------------------

CURVE = """
counts as (select probability as score, count(*) filter (where isFraud = 1) as positives, count(*) filter (where isFraud = 0) as negatives from txn group by 1),
curve as (select *, sum(positives) over (order by score desc) as tp, sum(negatives) over (order by score desc) as fp,
  sum(positives) over () as p_total, sum(negatives) over () as n_total from counts),
points as (select *, tp / (tp + fp) as prec, tp / p_total as rec from curve)"""


@query("eval_pr_curve", txn_sql(f"select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, {r('prec', 'precision')}, {r('rec', 'recall')} from points", CURVE))
def _curve(spark, sf_dir):
    """A small chunk size sends even the small table through several chunks."""
    return evaluation.pr_curve(txn(spark, sf_dir), chunk_rows=100).select("score", "tp", "fp", rounded("precision"), rounded("recall"))


@query("eval_average_precision", txn_sql(f"select {r('sum(positives * prec) / max(p_total)', 'average_precision')} from points", CURVE))
def _ap(spark, sf_dir):
    return evaluation.ranking_metrics(evaluation.pr_curve(txn(spark, sf_dir))).select(rounded("average_precision"))


@query("eval_roc_auc", txn_sql(f"select {r('sum(positives * (n_total - fp + negatives / 2.0)) / max(p_total * n_total)', 'roc_auc')} from points", CURVE))
def _auc(spark, sf_dir):
    return evaluation.ranking_metrics(evaluation.pr_curve(txn(spark, sf_dir))).select(rounded("roc_auc"))


def threshold_sql(floor):
    return txn_sql(f"""select floor, coalesce(t.score, f.score) as threshold,
      case when t.score is not null then 'maximum_recall_with_precision_at_least_' || floor else 'maximum_f1_fallback' end as method,
      {r('coalesce(t.prec, f.prec)', 'precision')}, {r('coalesce(t.rec, f.rec)', 'recall')}
    from (values {floor}) v(floor, cut)
    left join lateral (select * from points where prec >= cut order by score limit 1) t on true
    left join lateral (select * from points order by 2 * prec * rec / greatest(prec + rec, 1e-12) desc, score limit 1) f on true""", CURVE)


@query("eval_threshold", threshold_sql("('0.10', 0.10), ('0.05', 0.05), ('0.99', 0.99)"))
def _threshold(spark, sf_dir):
    curve = write_through(evaluation.pr_curve(txn(spark, sf_dir)), "curve")
    rows = None
    for text in ("0.10", "0.05", "0.99"):
        one = evaluation.operating_threshold(curve, floor=float(text)).select(
            F.lit(text).alias("floor"), "threshold", "method", rounded("precision"), rounded("recall"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


CONFUSION = f"""count(*) as rows, {r('avg(isFraud)', 'fraud_rate')}, count(*) filter (where not hit and isFraud = 0) as tn, count(*) filter (where hit and isFraud = 0) as fp,
  count(*) filter (where not hit and isFraud = 1) as fn, count(*) filter (where hit and isFraud = 1) as tp,
  {r('avg(pow(probability - isFraud, 2))', 'brier_score')},
  {r('coalesce(count(*) filter (where hit and isFraud = 1) / nullif(count(*) filter (where hit), 0), 0)', 'precision')},
  {r('coalesce(count(*) filter (where hit and isFraud = 1) / nullif(count(*) filter (where isFraud = 1), 0), 0)', 'recall')},
  {r('coalesce(2 * count(*) filter (where hit and isFraud = 1) / nullif(count(*) filter (where hit) + count(*) filter (where isFraud = 1), 0), 0)', 'f1')}"""
RATIOS = ["fraud_rate", "brier_score", "precision", "recall", "f1"]


@query("eval_confusion", txn_sql(f"select {CONFUSION} from (select *, probability >= 0.75 as hit from txn)"))
def _confusion(spark, sf_dir):
    return evaluation.confusion(txn(spark, sf_dir), 0.75).withColumns({c: rounded(F.col(c)) for c in RATIOS})


@query("eval_capacity", txn_sql(f"""
select share, reviewed_rows, cast(sum(isFraud) as bigint) as fraud_captured, {r('sum(isFraud) / max(p)', 'recall')}, {r('sum(isFraud) / reviewed_rows', 'precision')}
from (select isFraud, row_number() over (order by probability desc, TransactionID) as rn, count(*) over () as n, sum(isFraud) over () as p from txn),
  lateral (select share, greatest(1, cast(ceil(n * f) as bigint)) as reviewed_rows from (values ('top_1_percent', 0.01::double), ('top_5_percent', 0.05::double), ('top_10_percent', 0.1::double)) v(share, f))
where rn <= reviewed_rows group by share, reviewed_rows"""))
def _capacity(spark, sf_dir):
    return evaluation.capacity(txn(spark, sf_dir), chunk_rows=300).withColumns({c: rounded(F.col(c)) for c in ("recall", "precision")})


GROUPED_CURVE = """
counts as (select split, probability as score, count(*) filter (where isFraud = 1) as positives, count(*) filter (where isFraud = 0) as negatives from split where split <> 'train' group by all),
curve as (select *, sum(positives) over (partition by split order by score desc) as tp, sum(negatives) over (partition by split order by score desc) as fp,
  sum(positives) over (partition by split) as p_total, sum(negatives) over (partition by split) as n_total from counts),
ranking as (select split, """ + r("sum(positives * tp / (tp + fp)) / max(p_total)", "average_precision") + ", " + r("sum(positives * (n_total - fp + negatives / 2.0)) / max(p_total * n_total)", "roc_auc") + " from curve group by split)"


@query("eval_by_split", txn_sql(f"select * from (select split, {CONFUSION} from (select *, probability >= 0.75 as hit from split where split <> 'train') group by split) join ranking using (split)", SPLIT_SQL, GROUPED_CURVE))
def _by_split(spark, sf_dir):
    from riskspark.operators import sampling
    rows = sampling.split_chronological(txn(spark, sf_dir)).where("split <> 'train'")
    return evaluation.evaluate(rows, 0.75, by=["split"]).withColumns({c: rounded(F.col(c)) for c in [*RATIOS, "average_precision", "roc_auc"]})


LOGITS = """
logits as (select TransactionID, isFraud, ln(a / (1 - a)) as la, ln(b / (1 - b)) as lb from (
  select TransactionID, isFraud, least(greatest(probability, 1e-6::double), 1 - 1e-6::double) as a, least(greatest(probability_b, 1e-6::double), 1 - 1e-6::double) as b from txn))"""


@query("blend_apply", txn_sql(f"select TransactionID, {r('1.0 / (1.0 + exp(-least(greatest(0.35::double * la + (1 - 0.35::double) * lb, -40.0), 40.0)))', 'probability')} from logits", LOGITS))
def _blend(spark, sf_dir):
    return txn(spark, sf_dir).select("TransactionID", rounded(evaluation.blend(F.col("probability"), F.col("probability_b"), 0.35)).alias("probability"))


@query("blend_fit", txn_sql(f"""
select g as grid, {r('max(w)', 'first_weight')}, {r('1 - max(w)', 'second_weight')}, {r('sum(p * tp / (tp + fp)) / sum(p)', 'average_precision', 6)} from (
  select g, w, score, p, sum(p) over (partition by g order by score desc) as tp, sum(n) over (partition by g order by score desc) as fp from (
    select g, w, w * la + (1 - w) * lb as score, count(*) filter (where isFraud = 1) as p, count(*) filter (where isFraud = 0) as n
    from logits, (select g, case when g = 100 then 1.0::double else g * 0.01::double end as w from range(101) t(g)) group by all)) group by g""", LOGITS))
def _blend_fit(spark, sf_dir):
    fitted = evaluation.blend_fit(txn(spark, sf_dir), "probability", "probability_b")
    return fitted.select(F.col("grid").cast("bigint").alias("grid"), rounded("first_weight"), rounded("second_weight"), rounded("average_precision", 6))


@query("cv_summary", txn_sql(f"""
select name, {r('avg(share)', 'mean')}, {r('stddev_samp(share)', 'std')} from (select ProductCD as name, TransactionDT // 604800 as fold, avg(probability) as share from txn group by all) group by name"""))
def _cv(spark, sf_dir):
    folds = txn(spark, sf_dir).groupBy(F.col("ProductCD").alias("name"), F.floor(F.col("TransactionDT") / 604800).alias("fold")).agg(F.avg("probability").alias("validation_pr_auc"))
    return evaluation.cv_summary(folds).select("name", rounded("mean"), rounded("std"))
