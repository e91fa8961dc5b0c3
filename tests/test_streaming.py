import pytest
from pyspark.sql import functions as F

from riskspark.operators import history as h
from riskspark.operators.history import KEY_HISTORIES
from riskspark.operators import reference_state as ref
from riskspark.operators.bucketed_state import BucketedState
from riskspark.functions.row_features import with_v2_row_features
from riskspark.streaming import replay
from riskspark.streaming.keyed_state import _past_of_key
from riskspark.streaming.replay import append_replay, drained, paced, read_replay, write_replay
from riskspark.streaming.scoring import StreamJob
from tests.conftest import rows
from tests.fixtures import HISTORY_SCHEMA
from tests.test_history import by_id, generated
from tests.test_reference_state import close, names


def score(features):
    odd = F.when(F.col("TransactionID") % 2 == 1, 0.9).otherwise(0.1)
    return features.select("TransactionID", F.lit("m").alias("model_identifier"), odd.alias("risk_score"))


SMALL = [h.KeyHistory("uid_proxy", amounts=True, distinct=("P_emaildomain",))]


def start(spark, folder, df, specs=KEY_HISTORIES, **options):
    schema = write_replay(df, f"{folder}/in")
    job = StreamJob(spark, f"{folder}/out", score, spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double"), list(specs), **options)
    job.seed(schema)
    return job, schema


def test_stream_equals_batch_with_compaction_and_retry(spark, tmp_path):
    df = spark.createDataFrame(generated(120, seed=4), HISTORY_SCHEMA)
    job, schema = start(spark, tmp_path, df, compact_every=2)
    drained(job.start(f"{tmp_path}/in", schema, f"{tmp_path}/check", rows_per_trigger=30))
    found, causal = by_id(job.output("features")), by_id(h.causal_features(df))
    assert len(found) == 120
    for ident, row in found.items():
        close(row, causal[ident], names())
    before = rows(job.output("alerts"), "TransactionID")
    job.process(job.output("features").where("batch = 3").select(*schema.fieldNames()), 3)  # the same batch again
    assert rows(job.output("alerts"), "TransactionID") == before
    totals = rows(job.totals())[0]
    assert (totals["received_count"], totals["processed_count"], totals["failed_count"], totals["fraud_count"]) == (120, 120, 0, 60)
    # A second start finds nothing new; a late row is refused.
    late = df.where("TransactionID = 5").withColumn("sequence_number", F.lit(999).cast("int")).select(*schema.fieldNames())
    append_replay(late, f"{tmp_path}/in")
    drained(job.start(f"{tmp_path}/in", schema, f"{tmp_path}/check", rows_per_trigger=30))
    refused = rows(job.output("dead_letters"))
    assert [r["TransactionID"] for r in refused] == [5] and job.output("features").count() == 120


def test_bad_rows_and_copies_do_not_stop_the_stream(spark, tmp_path):
    data = [(1, 10, 5.0, 1, 0), (2, 20, -1.0, 1, 1), (3, 30, 7.0, 1, 2), (3, 30, 7.0, 1, 3), (4, 40, None, 1, 4)]
    df = spark.createDataFrame(data, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, sequence_number long")
    append_replay(df, f"{tmp_path}/in")
    labels = spark.createDataFrame([(1, True), (3, False)], "TransactionID long, actual_label boolean")
    job = StreamJob(spark, f"{tmp_path}/out", score, spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double"), [h.KeyHistory("card1_key")], labels=labels)
    job.seed(df.schema)
    drained(job.start(f"{tmp_path}/in", df.schema, f"{tmp_path}/check"))
    assert {r["TransactionID"]: r["card1_key_prior_count"] for r in rows(job.output("features"))} == {1: 0, 3: 1, 4: 2}
    assert sorted(r["sequence_number"] for r in rows(job.output("dead_letters"))) == [1, 3]
    assert {r["TransactionID"]: r["actual_label"] for r in rows(job.output("predictions"))} == {1: True, 3: False, 4: None}
    assert [(r["TransactionID"], r["suspicious_amount"]) for r in rows(job.output("alerts"), "TransactionID")] == [(1, 5.0), (3, 7.0)]


def test_late_rows_inside_a_batch_are_refused(spark, tmp_path):
    data = [(4, 100, 5.0, 1, 0), (5, 50, 5.0, 1, 1), (6, 100, 5.0, 1, 2), (3, 100, 5.0, 1, 3), (7, 300, -1.0, 1, 4), (8, 200, 5.0, 1, 5)]
    df = spark.createDataFrame(data, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, sequence_number long")
    append_replay(df, f"{tmp_path}/in")
    job = StreamJob(spark, f"{tmp_path}/out", score, spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double"), [h.KeyHistory("card1_key")])
    job.seed(df.schema)
    drained(job.start(f"{tmp_path}/in", df.schema, f"{tmp_path}/check"))
    assert {r["TransactionID"]: r["card1_key_prior_count"] for r in rows(job.output("features"))} == {4: 0, 6: 1, 8: 2}
    assert sorted(r["TransactionID"] for r in rows(job.output("dead_letters"))) == [3, 5, 7]


def test_max_of_earlier_in_chunks(spark):
    from riskspark.operators.ordering import max_of_earlier

    values = [3, 1, None, 7, 2, 9, 4, 4, 8, 10]
    df = spark.createDataFrame(list(enumerate(values)), "at int, v int").repartition(3)
    for chunk_rows in (2, 1000):
        found = rows(max_of_earlier(df, [F.col("at")], F.col("v"), "m", chunk_rows=chunk_rows), "at")
        assert [r["m"] for r in found] == [max((v for v in values[:i] if v is not None), default=None) for i in range(10)]


def test_many_batches_read_their_own_buckets_only(spark, tmp_path):
    """Twenty-two batches with compaction, equal to one window and one state over all rows."""
    df = spark.createDataFrame(generated(220, seed=8), HISTORY_SCHEMA)
    job, schema = start(spark, tmp_path, df, SMALL, compact_every=5, buckets=16)
    drained(job.start(f"{tmp_path}/in", schema, f"{tmp_path}/check", rows_per_trigger=10))
    found, causal = by_id(job.output("features")), by_id(h.causal_features(df))
    assert len(found) == 220 and job.output("counters").select("batch").distinct().count() == 22
    for ident, row in found.items():
        close(row, causal[ident], h.spec_features(SMALL[0]))
    whole, built = job.state.whole(22), ref.build(df, SMALL)
    columns = built.keyed["uid_proxy"].columns
    assert rows(whole.keyed["uid_proxy"].select(*columns), "key") == rows(built.keyed["uid_proxy"], "key")
    assert rows(whole.pairs, "column", "key", "value") == rows(built.pairs, "column", "key", "value")
    assert rows(job.state.meta(22)) == rows(built.meta)
    metrics = rows(job.metrics())[0]
    assert (metrics["received"], metrics["processed"], metrics["failed"], metrics["fraud_alerts"]) == (220, 220, 0, 110)
    assert metrics["p95_latency_ms"] > 0 and metrics["throughput"] > 0 and metrics["average_latency_ms"] > 0
    events = job.output("events")
    assert events.count() == 220 and events.where("arrival_time > processing_started_at + 1 or processing_started_at > completed_at").isEmpty()
    # The old versions of rewritten buckets can go; nothing that is read has gone with them.
    import shutil

    gone = job.state.superseded(22)
    assert gone and all("/base/" in g for g in gone)
    for folder in gone:
        shutil.rmtree(folder)
    assert rows(job.state.whole(22).keyed["uid_proxy"].select(*columns), "key") == rows(built.keyed["uid_proxy"], "key")


def test_files_scanned_follow_the_batch(spark, tmp_path):
    base = spark.range(4000).selectExpr("id as TransactionID", "id as TransactionDT", "1.0D as TransactionAmt", "id as card1", "cast(id as string) as P_emaildomain")
    specs = [h.KeyHistory("card1_key", distinct=("P_emaildomain",))]
    store = BucketedState(spark, str(tmp_path), specs, buckets=64, compact_every=3)
    store.create(ref.build(base, specs))
    files = lambda state: sum(len(t.inputFiles()) for t in (state.keyed["card1_key"], state.pairs))
    whole = files(store.whole(0))
    for batch in range(7):
        new = spark.createDataFrame([(5000 + 3 * batch + n, 5000 + 3 * batch + n, 2.0, card, mail) for n, (card, mail) in enumerate([(7, "7"), (7, "new"), (9000 + batch, None)])], "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, P_emaildomain string")
        state = store.before(batch, with_v2_row_features(new))
        deltas = 2 * ((batch - 1) % 3 if batch else 0) + 2  # of two tables, a file or two each
        assert files(state) <= 2 + 3 + 4 * deltas < whole
        found = {r["key"]: r["n"] for r in state.keyed["card1_key"].collect()}
        assert found["7"] == 1 + 2 * batch
        assert {r["value"] for r in state.pairs.where("key = '7'").collect()} >= ({"7"} | ({"new"} if batch else set()))
        assert state.keyed["card1_key"].count() < 400
        store.append(batch, new, state)
    manifest = store.manifest(7)
    assert sum(v != -1 for v in manifest["card1_key"].values()) <= 1 + 7 < len(manifest["card1_key"])
    assert store.whole(7).keyed["card1_key"].count() == 4007 and store.whole(7).pairs.count() == 4008


def test_retry_of_a_compacting_batch(spark, tmp_path):
    df = spark.createDataFrame(generated(60, seed=2), HISTORY_SCHEMA)
    job, schema = start(spark, tmp_path, df, SMALL, compact_every=2, buckets=4)
    drained(job.start(f"{tmp_path}/in", schema, f"{tmp_path}/check", rows_per_trigger=15))
    before = rows(job.state.whole(4).keyed["uid_proxy"], "key")
    for batch in (2, 3):
        job.process(job.output("features").where(F.col("batch") == batch).select(*schema.fieldNames()), batch)
    assert rows(job.state.whole(4).keyed["uid_proxy"], "key") == before


def reader(path, schema, **options):
    return replay.ReplayReader({"path": path, **{k: str(v) for k, v in options.items()}}, schema)


def test_offsets_order_and_restart(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as TransactionID", "(997 * id) % 1000 as TransactionDT", "cast(id as decimal(9,2)) as d", "array(id) as a")
    path = f"{tmp_path}/in"
    schema = write_replay(df, path)
    seen = []
    source = read_replay(spark, path, schema, rows_per_trigger=130)
    run = lambda: drained(paced(
        source.writeStream.foreachBatch(lambda rows_, batch: seen.append((batch, [(r["sequence_number"], r["TransactionDT"]) for r in rows_.orderBy("sequence_number").collect()])))
        .option("checkpointLocation", f"{tmp_path}/check"), rows_per_trigger=130, rate=None).start())
    run()
    assert [len(r) for _, r in seen] == [130] * 7 + [90] and sum((r for _, r in seen), []) == [(n, n) for n in range(1000)]
    run()  # nothing new
    assert len(seen) == 8
    # Rows behind a gap come next; the gap makes no empty batches, whatever the files' times say.
    append_replay(spark.read.schema(schema).parquet(f"{path}/rows/part=0").limit(3).withColumn("sequence_number", F.lit(9000).cast("long") + F.monotonically_increasing_id() % 3), path)
    run()
    assert [b for b, _ in seen[8:]] == [8] and {n for n, _ in seen[8][1]} <= {9000, 9001, 9002}
    # Partitions of a large batch are ranges; each row is read by one of them.
    one = reader(path, schema, rowsPerTrigger=1000, rowsPerTask=77)
    parts = one.partitions(one.initialOffset(), one.latestOffset())
    assert len(parts) >= 13 and sorted(n for p in parts for b in one.read(p) for n in b.column(schema.fieldNames().index("sequence_number")).to_pylist()) == list(range(1000))
    again = reader(path, schema, rowsPerTrigger=10)  # restarted: the last batch is planned again, then the next follows
    again.partitions({"next": 20}, {"next": 30})
    assert again.latestOffset() == {"next": 40}
    with pytest.raises(ValueError):
        reader(path, schema, rowsPerTrigger=0)


@pytest.mark.parametrize("rate", replay.RATES)
def test_rates(spark, tmp_path, rate):
    """Batches start as far apart as the rate says."""
    import time

    df = spark.range(3 * rate).selectExpr("id as TransactionID", "id as TransactionDT")
    schema = write_replay(df, f"{tmp_path}/in")
    starts = []
    source = read_replay(spark, f"{tmp_path}/in", schema, rows_per_trigger=rate)
    query = paced(source.writeStream.foreachBatch(lambda r, b: starts.append((time.time(), r.count()))).option("checkpointLocation", f"{tmp_path}/c"), rows_per_trigger=rate, rate=rate).start()
    drained(query)
    assert [n for _, n in starts] == [rate] * 3 and starts[2][0] - starts[1][0] > 0.6
    with pytest.raises(ValueError):
        paced(source.writeStream, rows_per_trigger=1, rate=3)


def test_a_batch_is_fetched_once(spark, tmp_path):
    """Every row of the source passes the counter once, however many steps read the batch."""
    data = [(n, 10 * n, 5.0, 1, n) for n in range(1, 21)]
    df = spark.createDataFrame(data, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, sequence_number long")
    job = StreamJob(spark, f"{tmp_path}/out", score, spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double"), [h.KeyHistory("card1_key")])
    job.seed(df.schema)
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    job.process(df.mapInArrow(counted, df.schema), 0)
    assert read.value == 20 and job.output("features").count() == 20


def test_keyed_past_needs_no_frame_work_for_one_part():
    """A key's rows come as one frame nearly always; they are neither joined nor sorted as frames."""
    import pandas as pd

    class Held:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    class Plain(pd.DataFrame):
        def sort_values(self, *args, **kwargs):
            raise AssertionError("sorted as a frame")

        _constructor = property(lambda self: Plain)

    part = Plain({"TransactionID": [3, 1, 2], "TransactionDT": [20, 10, 10], "unit": [3000.0, 1000.0, None]})
    state = Held()
    found = next(_past_of_key(("k",), iter([part]), state))
    assert found["TransactionID"].tolist() == [1, 2, 3] and found["amount_prior_numeric_count"].tolist() == [0, 1, 1]
    assert state.kept[:4] == (3, 20.0, 2, 4000)


def test_max_of_earlier_by_number_writes_nothing(spark, monkeypatch):
    from riskspark.operators import ordering

    values = [(0, 3), (1, 1), (1, None), (5, 7), (40, 2), (41, 9), (None, 4), (90, 4), (None, 8), (91, 10)]
    df = spark.createDataFrame([(n, v, at) for at, (n, v) in enumerate(values)], "n int, v int, at int").repartition(3)
    inorder = sorted(range(10), key=lambda at: (values[at][0] is not None, values[at][0] or 0, at))
    expected = {at: max((values[a][1] for a in inorder[:place] if values[a][1] is not None), default=None) for place, at in enumerate(inorder)}
    monkeypatch.setattr(ordering, "write_through", None)
    for chunk_rows in (1, 2, 1000):
        found = rows(ordering.max_of_earlier(df, [F.col("n"), F.col("at")], F.col("v"), "m", chunk_rows=chunk_rows, number="n"))
        assert {r["at"]: r["m"] for r in found} == expected


@pytest.mark.parametrize("hot_rows", [1_000_000, 15])
def test_carried_rows_have_the_history_of_joined_rows(spark, hot_rows):
    """Known state, new pairs of the batch and hot keys: rows that are carried get what rows get that are written and joined again."""
    df = spark.createDataFrame(generated(200, seed=12), HISTORY_SCHEMA)
    cut = sorted(r["TransactionDT"] for r in df.select("TransactionDT").collect())[120]
    early, late = df.where(F.col("TransactionDT") < cut), df.where(F.col("TransactionDT") >= cut)
    state = ref.build(early)
    featured = with_v2_row_features(late)
    plain = h.with_history(featured, state.specs, hot_rows=hot_rows, known=h.KnownState(state.keyed, state.pairs))
    fresh = ref.fresh_pairs(featured, state.specs, state.pairs)
    carried = h.with_row_history(late, state.specs, hot_rows=hot_rows, known=h.KnownState(state.keyed, state.pairs, fresh))
    assert carried.columns == plain.columns and carried.dtypes == plain.dtypes
    found, expected = by_id(carried), by_id(plain)
    assert len(found) == late.count() > 50 and found == expected
    added = ref.delta(late, state.specs, state.pairs), ref.delta(late, state.specs, state.pairs, fresh=fresh)
    assert rows(added[0].pairs, "column", "key", "value") == rows(added[1].pairs, "column", "key", "value")
    assert rows(added[0].keyed["uid_proxy"], "key") == rows(added[1].keyed["uid_proxy"], "key")


def test_a_batch_is_not_written_again_for_its_history(spark, tmp_path, monkeypatch):
    """Rows are written as fetched and as judged; order, history and known pairs need no further copy of them."""
    from riskspark import session
    from riskspark.operators import ordering
    from riskspark.streaming import scoring

    labels = []

    def recorded(frame, label):
        labels.append(label)
        return session.write_through(frame, label)

    for module in (h, ordering, ref, scoring):
        monkeypatch.setattr(module, "write_through", recorded)
    df = spark.createDataFrame([(n, 10 * n, 5.0, n % 3, str(n % 4), n) for n in range(1, 21)], "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, P_emaildomain string, sequence_number long")
    job = StreamJob(spark, f"{tmp_path}/out", score, spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double"), list(SMALL))
    job.seed(df.schema)
    labels.clear()
    job.process(df, 0)
    assert job.output("features").count() == 20
    assert sorted(labels) == ["hot-keys", "state-pairs", "stream-batch", "stream-fetched", "stream-repeated"]


FAILING = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, sequence_number long"


def run_with_failures(spark, folder):
    """Ten rows in two batches: two without an id, a negative amount, and one each that the model scores with nothing, NaN, 1.5 and not at all."""
    ids = [1, None, 3, 4, 5, 6, None, 8, 9, 11]
    df = spark.createDataFrame([(i, 10 * (n + 1), -1.0 if i == 3 else 2.0, 7, n) for n, i in enumerate(ids)], FAILING)
    append_replay(df, f"{folder}/in")

    def failing(features):
        odd = F.when(F.col("TransactionID") == 5, F.lit(float("nan"))).when(F.col("TransactionID") == 8, 1.5).when(F.col("TransactionID") != 4, 0.9)
        return features.where("TransactionID <> 6").select("TransactionID", F.lit("m").alias("model_identifier"), odd.alias("risk_score"))

    thresholds = spark.createDataFrame([("m", 0.5)], "model_identifier string, threshold double")
    job = StreamJob(spark, f"{folder}/out", failing, thresholds, [h.KeyHistory("card1_key")])
    job.seed(df.schema)
    drained(job.start(f"{folder}/in", df.schema, f"{folder}/check", rows_per_trigger=5))
    return job


@pytest.fixture(scope="module")
def failures(spark, tmp_path_factory):
    return run_with_failures(spark, tmp_path_factory.mktemp("failures"))


def test_counters_have_every_row_and_failure(failures):
    """Rows without an id are received and fail; a row that no model scored isn't processed, and NaN or 1.5 isn't fraud."""
    found = rows(failures.totals())[0]
    assert found == {"received_count": 10, "processed_count": 3, "failed_count": 7, "fraud_count": 3, "suspicious_value": 6.0, "current_sequence": 9}
    assert sorted(r["TransactionID"] for r in rows(failures.output("alerts"))) == [1, 9, 11]


def test_dead_letters_have_every_failed_row(failures):
    from riskspark.operators.contract import AMOUNT_TEXT, FINITE_ID_TEXT, INVALID_CODE
    from riskspark.streaming.scoring import UNSCORED_CODE, UNSCORED_TEXT

    found = {r["sequence_number"]: (r["TransactionID"], r["TransactionDT"], r["error_code"], r["error_message"]) for r in rows(failures.output("dead_letters"))}
    unscored = {n: (ident, 10 * (n + 1), UNSCORED_CODE, UNSCORED_TEXT) for n, ident in ((3, 4), (4, 5), (5, 6), (7, 8))}
    nameless = {n: (None, 10 * (n + 1), INVALID_CODE, FINITE_ID_TEXT) for n in (1, 6)}
    assert found == {2: (3, 30, INVALID_CODE, AMOUNT_TEXT)} | nameless | unscored
    assert failures.output("dead_letters").count() == 7


def test_metrics_have_every_row_and_failure(failures):
    from riskspark.operators.contract import INVALID_CODE
    from riskspark.streaming.scoring import UNSCORED_CODE

    found = rows(failures.metrics())[0]
    assert (found["received"], found["processed"], found["failed"], found["fraud_alerts"], found["suspicious_value"]) == (10, 3, 7, 3, 6.0)
    codes = {r["sequence_number"]: (r["status"], r["error_code"]) for r in rows(failures.output("events"))}
    assert codes == {n: ("FAILED", INVALID_CODE) if n in (1, 2, 6) else ("FAILED", UNSCORED_CODE) if n in (3, 4, 5, 7) else ("COMPLETED", None) for n in range(10)}
