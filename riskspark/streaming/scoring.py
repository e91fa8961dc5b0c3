"""Score an ordered stream against state that is updated after each batch.

Within a batch every row sees the stored state plus the earlier rows of its own batch,
which equals scoring and updating row by row. The state lies in hash buckets, of which
a batch reads its own. All outputs of batch N go to folders named after N and are
overwritten when N is retried; batch N reads only what earlier batches wrote, so a
retry gives the same result (but for the times in ``events``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskspark.functions.row_features import number, with_v2_row_features
from riskspark.operators import reference_state as ref
from riskspark.operators.bucketed_state import BucketedState
from riskspark.operators.cases import apply_threshold, derive_alerts, invalid_score, stream_metrics
from riskspark.operators.contract import DUPLICATE_CODE, DUPLICATE_TEXT, INVALID_CODE, OVERLAP_TEXT, validate_rows
from riskspark.operators.history import KEY_HISTORIES, KeyHistory, KnownState, with_row_history
from riskspark.operators.ordering import event_order, max_of_earlier
from riskspark.schema import AMOUNT, ID, TIME
from riskspark.session import at_once, single_row, write_through
from riskspark.streaming.replay import FETCH_ROWS, paced, read_replay

Scorer = Callable[[DataFrame], DataFrame]
ARRIVAL = "_arrival_time"  # when the row's micro-batch was fetched
# Fixed value: error code of an accepted row that a model could not score.
UNSCORED_CODE = "model_prediction_failed"
UNSCORED_TEXT = "a model gave no score from 0 to 1 for this transaction"
JUDGED_ROWS = 1 << 15  # sequence numbers of a chunk in which rows are compared with those ahead


@dataclass
class StreamJob:
    """One replay: where it reads and writes, which keys it tracks, how it scores."""

    spark: SparkSession
    out_dir: str
    scorer: Scorer
    thresholds: DataFrame
    specs: list[KeyHistory] = field(default_factory=lambda: list(KEY_HISTORIES))
    labels: DataFrame | None = None
    sequence: str = "sequence_number"
    compact_every: int = 8
    buckets: int = 64
    run_id: str = "run"

    # --- state ---

    @property
    def state(self) -> BucketedState:
        return BucketedState(self.spark, f"{self.out_dir}/state", self.specs, self.buckets, self.compact_every)

    def seed(self, schema: T.StructType, history: DataFrame | None = None) -> None:
        """Write the state the first batch starts from; empty without ``history``."""
        rows = history if history is not None else self.spark.createDataFrame([], schema)
        columns = with_v2_row_features(rows).columns
        self.specs = [s.present(columns) for s in self.specs]
        self.state.create(ref.delta(rows, self.specs, None))

    # --- one batch ---

    def judge(self, rows: DataFrame, meta: DataFrame) -> DataFrame:
        """Verdict per row: later copies of an id, contract failures (a missing id is one), rows that came too late.

        A row is too late at or before the end of the stored history, or of any valid row ahead of it in this batch; a row
        refused for that doesn't move the end, because it lies before it.
        """
        end = meta.first()  # one row of metadata
        cutoff = None
        if end["history_end_transaction_dt"] is not None:
            cutoff = (end["history_end_transaction_dt"], end["history_end_transaction_id"])
        # Only repeated ids come back to the rows; written first, so that a short list is broadcast.
        firsts = rows.groupBy(ID).agg(F.min(self.sequence).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        copied = F.coalesce(F.col(self.sequence) > F.col("_first"), F.lit(False))  # a missing id is no copy of another
        marked = rows.join(write_through(firsts, "stream-repeated"), ID, "left").withColumn("_copy", copied).drop("_first")

        def refuse(judged: DataFrame, which: Column, message: str, code: str) -> DataFrame:
            return judged.withColumns({
                "error_message": F.when(which, F.lit(message)).otherwise(F.col("error_message")),
                "error_code": F.when(which, F.lit(code)).otherwise(F.col("error_code")),
            })

        # Copies are judged here, so that the first copy is still scored; like all refused rows they don't move the end.
        judged = refuse(validate_rows(marked, cutoff=cutoff, unique=True), F.col("_copy"), DUPLICATE_TEXT, DUPLICATE_CODE).drop("_copy")
        event = F.struct(number(TIME).alias("t"), number(ID).alias("i"))
        placed = max_of_earlier(
            judged, [F.col(self.sequence), *event_order()], F.when(F.col("error_code").isNull(), event), "_end",
            chunk_rows=JUDGED_ROWS, number=self.sequence)
        late = F.col("error_code").isNull() & F.coalesce(F.col("_end") >= event, F.lit(False))
        return refuse(placed, late, OVERLAP_TEXT, INVALID_CODE).drop("_end")

    def process(self, batch_rows: DataFrame, batch: int) -> None:
        started = datetime.now(UTC)
        store = self.state
        fetched = write_through(batch_rows, "stream-fetched")  # the source is read once
        judged = write_through(self.judge(fetched, store.meta(batch)), "stream-batch")
        accepted = judged.where("error_code is null").drop("error_code", "error_message", ARRIVAL)
        featured = with_v2_row_features(accepted)
        state = store.before(batch, featured)  # only the buckets of these rows
        fresh = ref.fresh_pairs(featured, self.specs, state.pairs)  # known pairs are read here alone

        letters: list[DataFrame] = []

        def results() -> None:
            known = KnownState(state.keyed, state.pairs, fresh)
            features = self._write(with_row_history(accepted, self.specs, known=known), "features", batch)
            decided = apply_threshold(self.scorer(features), self.thresholds)
            context = features.select(ID, self.sequence, F.col(AMOUNT).alias("amount"))
            predictions = decided.join(context, ID)
            if self.labels is not None:  # labels meet predictions only here, after scoring
                predictions = predictions.join(self.labels, ID, "left")
            stored = self._write(predictions, "predictions", batch)
            dead = self._write(self._dead_letters(judged, stored), "dead_letters", batch)
            letters.append(dead)
            scored = stored.join(dead.where(F.col("error_code") == UNSCORED_CODE).select(ID), ID, "left_anti")
            alerts = self._write(derive_alerts(scored, [ID]), "alerts", batch)
            self._write(self._counters(judged, dead, alerts), "counters", batch)

        at_once(self.spark, [results, lambda: store.append(batch, accepted, state, fresh=fresh)])
        self._write(self._events(judged, letters[0], started), "events", batch)

    def _dead_letters(self, judged: DataFrame, predictions: DataFrame) -> DataFrame:
        """Refused rows, and accepted ones that no model scored or that a model gave no decision or no score from 0 to 1.

        The latter keep their place in the history, which is known before the scores.
        """
        columns = [ID, TIME, self.sequence, "error_code", "error_message"]
        faulty = F.col("decision").isNull() | invalid_score()
        scored = predictions.groupBy(ID).agg(F.count_if(faulty).alias("_faulty")).where("_faulty = 0").select(ID)
        unscored = judged.where("error_code is null").join(scored, ID, "left_anti").withColumns(
            {"error_code": F.lit(UNSCORED_CODE), "error_message": F.lit(UNSCORED_TEXT)})
        return judged.where("error_code is not null").select(*columns).unionByName(unscored.select(*columns))

    def _events(self, judged: DataFrame, dead: DataFrame, started: datetime) -> DataFrame:
        """The life of each row in epoch seconds: when its batch was fetched, begun and done, and how it ended."""
        # Ids of accepted rows are there and don't repeat; a refused copy of one keeps its own code.
        unscored = dead.where(F.col("error_code") == UNSCORED_CODE).select(ID, F.col("error_code").alias("_unscored"))
        judged = judged.join(unscored, ID, "left").withColumn("error_code", F.coalesce("error_code", "_unscored"))
        begun, now = F.lit(started.timestamp()), F.lit(datetime.now(UTC).timestamp())
        arrival = F.unix_micros(F.col(ARRIVAL)) / F.lit(1e6) if ARRIVAL in judged.columns else begun
        status = F.when(F.col("error_code").isNull(), F.lit("COMPLETED")).otherwise(F.lit("FAILED"))
        return judged.select(
            F.lit(self.run_id).alias("run_id"), self.sequence, ID, arrival.alias("arrival_time"), begun.alias("processing_started_at"),
            now.alias("completed_at"), status.alias("status"), "error_code")

    def _counters(self, judged: DataFrame, dead: DataFrame, alerts: DataFrame) -> DataFrame:
        failed = F.col("_d.failed_count")
        rows = judged.agg(F.count(F.lit(1)).alias("received_count"), F.max(self.sequence).alias("current_sequence"))
        rows = rows.withColumn("_d", single_row(dead.agg(F.count(F.lit(1)).alias("failed_count")))).select(
            "received_count", (F.col("received_count") - failed).alias("processed_count"), failed, "current_sequence")
        flagged = alerts.agg(
            F.count(F.lit(1)).alias("fraud_count"),
            F.coalesce(F.sum(F.col("suspicious_amount").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("suspicious_value"))
        return rows.withColumn("_f", single_row(flagged)).select(*rows.columns, "_f.*")

    def _output(self, name: str, batch: int) -> str:
        return f"{self.out_dir}/{name}/batch={batch}"

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._output(name, batch))
        return self.spark.read.schema(df.schema).parquet(self._output(name, batch))

    # --- the query ---

    def start(self, in_dir: str, schema: T.StructType, checkpoint: str, *, rate: int | None = None, rows_per_trigger: int = FETCH_ROWS) -> StreamingQuery:
        """Start or resume. A stop finishes the running batch; the checkpoint continues after it."""
        source = read_replay(self.spark, in_dir, schema, rows_per_trigger=rows_per_trigger).withColumn(ARRIVAL, F.current_timestamp())
        writer = source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return paced(writer, rows_per_trigger=rows_per_trigger, rate=rate).start()

    def output(self, name: str) -> DataFrame:
        """All batches of one output table, with their batch number."""
        return self.spark.read.parquet(f"{self.out_dir}/{name}")

    def totals(self) -> DataFrame:
        return self.output("counters").agg(
            *[F.sum(c).alias(c) for c in ("received_count", "processed_count", "failed_count", "fraud_count")],
            F.round(F.sum("suspicious_value"), 2).alias("suspicious_value"), F.max("current_sequence").alias("current_sequence"))

    def metrics(self) -> DataFrame:
        """Counters, throughput and latencies from the job's own events and alerts."""
        return stream_metrics(self.output("events"), self.output("alerts").withColumn("run_id", F.lit(self.run_id)))
