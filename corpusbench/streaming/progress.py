"""Run progress folded from events, in batch and as a stream.

Every field of a model's progress is the value set by the last event that sets it, so folding is
``max_by`` over the event sequence: built-in aggregates that combine per task in batch and keep one
row of state per model in a stream.  ``seq`` gives the order; it must be unique per model.

A stream that must not keep every model it has ever seen uses ``ending_model_progress``: the same fold,
with state that goes some time after a model's last event was one that ends it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

C = F.col

TASK_EVENTS = ("task_started", "task_skipped", "task_completed")
START_EVENTS = ("run_started", "run_resumed", "task_started")
PHASE_EVENTS = ("phase_started", "phase_changed")
SAMPLE_EVENTS = ("sample_started", "sample_completed", "sample_restored")
DONE_EVENTS = ("sample_completed", "sample_restored")
END_EVENTS = ("task_skipped", "task_completed")


def _text(name: str) -> Column:
    """A non-empty text field, else NULL."""
    return F.nullif(F.coalesce(C(name), F.lit("")), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(C(name), F.lit(0)).cast("bigint")


def _last(value: Column, sets: Column) -> Column:
    """Value of the last event for which ``sets`` holds."""
    return F.max_by(value, F.when(sets, C("seq")))


def keyed_events(events: DataFrame) -> DataFrame:
    """Events with their model key; ids win over plain names and both have a default."""
    dataset = F.coalesce(_text("dataset_id"), _text("dataset"), F.lit("dataset"))
    preset = F.coalesce(_text("preset_id"), _text("preset"), F.lit("model"))
    return events.withColumns(
        {"dataset_key": dataset, "preset_key": preset}
    ).withColumn("model_key", F.concat_ws("::", "dataset_key", "preset_key"))


def _model_settings() -> dict[str, tuple[str, Column, Column]]:
    """Per field whether its first or its last event counts, which events set it, and to what."""
    event, every = C("event"), F.lit(True)
    is_task = event.isin(*TASK_EVENTS)
    done, ended = event.isin(*DONE_EVENTS), event.isin(*END_EVENTS)
    failed_sample = F.coalesce(C("status"), F.lit("")) == "failed"

    status = (
        F.when(event.isin(*START_EVENTS, *PHASE_EVENTS) | (event == "sample_started"), "running")
        .when(done, F.when(failed_sample, "warning").otherwise("running"))
        .when(ended, F.coalesce(_text("task_status"), F.lit("complete")))
        .when(event == "run_finished", F.coalesce(_text("run_status"), _text("status"), F.lit("complete")))
        .when(event == "run_interrupted", "interrupted")
    )
    own_phase = F.when(event == "task_skipped", "resumed").otherwise(_text("phase"))
    active = F.when(event == "sample_started", F.coalesce(C("sample_id"), F.lit(""))).otherwise("")
    sets_active = (event == "sample_started") | done | ended | event.isin("run_finished", "run_interrupted")
    uncounted = done & C("succeeded").isNull() & C("failed").isNull()
    succeeded = _number("succeeded") + F.when(uncounted & ~failed_sample, 1).otherwise(0)
    failed = _number("failed") + F.when(uncounted & failed_sample, 1).otherwise(0)
    counted = F.when(ended, _number("succeeded") + _number("failed")).when(
        done & (_number("completed") == 0), _number("index")
    ).otherwise(_number("completed"))
    sets_counts = ~is_task | ended

    def failure(name: str) -> tuple[str, Column, Column]:
        """Last value set, emptied by a task start."""
        value = F.when(event == "task_started", "").otherwise(_text(name))
        return "last", value.isNotNull(), value

    return {
        "dataset_id": ("first", every, C("dataset_key")),
        "preset_id": ("first", every, C("preset_key")),
        "model": ("last", _text("model").isNotNull(), _text("model")),
        "_phase": ("last", own_phase.isNotNull(), own_phase),
        "_phase_seq": ("last", own_phase.isNotNull(), C("seq")),
        "_task_seq": ("last", event == "task_started", C("seq")),
        "status": ("last", status.isNotNull(), status),
        "attempt": ("last", _number("attempt") != 0, _number("attempt")),
        "completed": ("last", sets_counts, counted),
        "succeeded": ("last", sets_counts, succeeded),
        "failed": ("last", sets_counts, failed),
        "_total": ("last", (_number("total") != 0) & (event != "task_started"), _number("total")),
        "_first_total": ("first", every, _number("total")),
        "active_sample": ("last", sets_active, active),
        "failure_code": failure("error_code"),
        "failure_type": failure("error_type"),
        "failure_message": failure("message"),
        "_started": ("first", event.isin(*START_EVENTS), C("ts")),
        "_latest": ("last", every, C("ts")),
        "last_seq": ("last", every, C("seq")),
    }


def _shown(folded: DataFrame) -> DataFrame:
    """Fields that no event has set, and those that follow from several."""
    defaults = dict.fromkeys(("model", "active_sample", "failure_code", "failure_type", "failure_message"), "")
    defaults |= {"status": "queued", "_phase": "queued", "attempt": 0, "completed": 0, "succeeded": 0, "failed": 0}
    # a start moves a queued task on to its preflight
    began = C("_task_seq").isNotNull() & (C("_phase_seq").isNull() | (C("_task_seq") >= C("_phase_seq")))
    return folded.withColumns({c: F.coalesce(c, F.lit(value)) for c, value in defaults.items()}).withColumns(
        {
            "total": F.coalesce("_total", "_first_total"),
            "phase": F.when((C("_phase") == "queued") & began, "preflight").otherwise(C("_phase")),
            "elapsed_seconds": F.when(
                C("_started").isNotNull(), F.greatest(F.lit(0.0), C("_latest") - C("_started"))
            ),
        }
    ).drop("_phase", "_phase_seq", "_task_seq", "_started", "_latest", "_total", "_first_total")


def model_progress(events: DataFrame) -> DataFrame:
    """Progress per model after all its events (or, in a stream, after those seen so far)."""
    keyed = keyed_events(events.where(~C("event").startswith("suite_")))
    fields = [
        (F.max_by if kind == "last" else F.min_by)(value, F.when(sets, C("seq"))).alias(name)
        for name, (kind, sets, value) in _model_settings().items()
    ]
    return _shown(keyed.groupBy("model_key").agg(*fields))


def _sample_row() -> Column:
    status = F.when(C("event") == "sample_started", "running").otherwise(
        F.coalesce(_text("status"), F.lit("ok"))
    )
    empty = F.lit("")
    return F.struct(
        F.coalesce("audio_path", empty).alias("audio_path"),
        _number("index").alias("position"),
        _number("total").alias("total"),
        status.alias("status"),
        F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"),
        F.coalesce("error_type", empty).alias("error_type"),
        F.coalesce("error_code", empty).alias("error_code"),
        F.coalesce(_text("message"), C("error_type"), empty).alias("message"),
    )


def _sample_events(events: DataFrame) -> DataFrame:
    keyed = keyed_events(events.where(C("event").isin(*SAMPLE_EVENTS)))
    return keyed.withColumn("sample_key", F.coalesce(_text("sample_id"), F.lit("sample")))


def sample_progress(events: DataFrame) -> DataFrame:
    """Latest state per model and sample; ``last_seq`` orders samples by recency."""
    row, named = _sample_row(), _sample_events(events)
    latest = named.groupBy("model_key", "sample_key").agg(
        F.max_by(row, "seq").alias("row"), F.max("seq").alias("last_seq")
    )
    return latest.select("model_key", C("sample_key").alias("sample_id"), "row.*", "last_seq")


def suite_progress(events: DataFrame, suite: Column | None = None) -> DataFrame:
    """Status per suite: waiting, running, the status its end carries, or interrupted."""
    event = C("event")
    finished = event.isin("suite_finished", "suite_completed")
    carried = F.coalesce(_text("suite_status"), _text("status"), _text("run_status"), F.lit("complete"))
    status = (
        F.when(event == "suite_started", "running")
        .when(finished, carried)
        .when(event == "suite_interrupted", "interrupted")
    )
    key = (F.lit("suite") if suite is None else suite).alias("suite_id")
    return events.groupBy(key).agg(
        F.coalesce(_last(status, status.isNotNull()), F.lit("waiting")).alias("status")
    )


def model_elapsed(events: DataFrame) -> DataFrame:
    """Wall-clock seconds per model from its first start to its latest event."""
    return model_progress(events).select("model_key", "elapsed_seconds")


# --- streams whose state ends ----------------------------------------------------------------------


@dataclass(frozen=True)
class Ending:
    """``progress`` rows say whether they are ``final``; ``late`` events came for a key whose state has gone."""

    progress: DataFrame
    late: DataFrame


_FOLDED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("state", T.StringType())
])
_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("ended", T.LongType())])


def ending_model_progress(events: DataFrame, *, grace: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """``model_progress`` of a stream with state that goes: rows of kind progress, final and late.

    A model's state goes ``grace`` seconds of event time (``ts``) after the event that ended it
    (``task_completed``, ``task_skipped``, ``run_finished`` or ``run_interrupted``), unless another event
    follows.  Then its last row comes once more, as final.  A state begins with a start event or
    ``task_skipped``; any other event of a model without state is late: it changes nothing and is told.
    ``ts`` may be out of order by ``delay``; what comes later still is dropped by the watermark and counted
    in the query's ``numRowsDroppedByWatermark``.  Split the result with ``ended``.
    """
    keyed = keyed_events(events.where(~C("event").startswith("suite_")))
    ends = (*END_EVENTS, "run_finished", "run_interrupted")
    return _ending(keyed, C("model_key"), _model_settings(), (*START_EVENTS, "task_skipped"), ends, grace, delay)


def ending_sample_progress(events: DataFrame, *, grace: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """``sample_progress`` of a stream; a sample's state goes ``grace`` seconds after it was completed or restored."""
    named = _sample_events(events)
    settings = {"row": ("last", F.lit(True), _sample_row()), "last_seq": ("last", F.lit(True), C("seq"))}
    key = F.to_json(F.struct("model_key", C("sample_key").alias("sample_id")))
    return _ending(named, key, settings, ("sample_started", "sample_restored"), DONE_EVENTS, grace, delay)


def _ending(
    keyed: DataFrame, key: Column, settings: dict[str, tuple[str, Column, Column]], begins: Sequence[str],
    ends: Sequence[str], grace: float, delay: str,
) -> DataFrame:
    fields = [F.when(sets, F.struct(C("seq"), value.alias("value"))).alias(name) for name, (_, sets, value) in settings.items()]
    seen = keyed.select(
        key.alias("key"), F.timestamp_seconds("ts").alias("at"), (C("ts") * 1000).cast("bigint").alias("ms"), "seq",
        C("event").isin(*begins).alias("begins"), C("event").isin(*ends).alias("ends"), F.to_json(F.struct(*fields)).alias("sets"),
        F.to_json(F.struct(*keyed.columns)).alias("event"),
    )
    first = {name for name, (kind, _, _) in settings.items() if kind == "first"}
    wait = int(grace * 1000)
    return seen.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        lambda k, parts, state: _fold(k, parts, state, first, wait), _FOLDED, _STATE, "update", "EventTimeTimeout"
    )


def _fold(
    key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState, first: set[str], wait: int
) -> Iterator[pd.DataFrame]:
    """Merge a key's events into its state: per field the first or last value set, by sequence number."""
    if state.hasTimedOut:
        kept = state.get[0]
        state.remove()
        yield pd.DataFrame([("final", key[0], kept)], columns=_FOLDED.names)
        return
    held = json.loads(state.get[0]) if state.exists else None
    late = []
    for part in parts:
        for row in part.sort_values("seq").itertuples(index=False):
            if held is None:
                if not row.begins:
                    late.append(("late", key[0], row.event))
                    continue
                held = {}
            for name, new in json.loads(row.sets).items():
                known = held.get(name)
                if known is None or (new["seq"] < known["seq"] if name in first else new["seq"] > known["seq"]):
                    held[name] = new
            if "" not in held or row.seq > held[""][0]:
                held[""] = [int(row.seq), int(row.ms) if row.ends else None]
    if held is not None:
        ended, told = held[""][1], json.dumps(held)
        state.update((told, -1 if ended is None else ended))
        if ended is not None:
            state.setTimeoutTimestamp(max(ended + wait, state.getCurrentWatermarkMs() + 1))
        late.append(("progress", key[0], told))
    yield pd.DataFrame(late, columns=_FOLDED.names)


def ended(rows: DataFrame, *, samples: bool = False) -> Ending:
    """The rows of one batch of an ending stream, as progress and as late events (JSON)."""
    kept = rows.where("kind <> 'late'")
    settings = {"row": None, "last_seq": None} if samples else dict.fromkeys(_model_settings())
    texts = {"dataset_id", "preset_id", "model", "_phase", "status", "active_sample", "failure_code", "failure_type", "failure_message"}
    row = "struct<audio_path:string,position:bigint,total:bigint,status:string,elapsed_seconds:double,error_type:string,error_code:string,message:string>"

    def kind(name: str) -> str:
        return row if name == "row" else "string" if name in texts else "double" if name in ("_started", "_latest") else "bigint"

    schema = ", ".join(f"`{name}` struct<seq:bigint,value:{kind(name)}>" for name in settings)
    read = kept.select("key", (C("kind") == "final").alias("final"), F.from_json("state", schema).alias("s"))
    late = rows.where("kind = 'late'").select("key", C("state").alias("event"))
    values = [C(f"s.{name}.value").alias(name) for name in settings]
    if samples:
        keys = F.from_json("key", "model_key string, sample_id string").alias("k")
        told = read.select(keys, "final", *values).select("k.*", "row.*", "last_seq", "final")
    else:
        told = _shown(read.select(C("key").alias("model_key"), "final", *values))
    return Ending(told, late)


def follow(
    progress: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    available_now: bool = False,
) -> StreamingQuery:
    """Send changed progress rows to ``write`` batch by batch, restartable from the checkpoint."""
    writer = progress.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
