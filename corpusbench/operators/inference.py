"""Batch transcription with a caller's backend, one loaded backend per partition."""

from __future__ import annotations

import resource
from collections.abc import Callable, Iterator
from time import perf_counter
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

RESULT_SCHEMA = (
    "sample_id string, status string, "
    "transcript struct<text:string, language:string, audio_duration_seconds:double, metadata:map<string,string>>, "
    "measurement struct<elapsed_seconds:double, process_rss_peak_bytes:bigint, "
    "gpu_peak_allocated_bytes:bigint, gpu_peak_reserved_bytes:bigint>, "
    "failure struct<stage:string, error_type:string, families:array<string>, message:string, sample_id:string, "
    "error_code:string, retryable:boolean>"
)
_COLUMNS = ["sample_id", "status", "transcript", "measurement", "failure"]


class Backend(Protocol):
    """What a caller supplies.

    ``transcribe`` returns a dict with ``text`` and, optionally, ``language``,
    ``audio_duration_seconds``, ``metadata`` and the two GPU peaks.  An exception may carry
    ``code`` and ``retryable`` of its own.  A backend may have ``preflight(sample)``, which raises
    for samples it should not be given.
    """

    def load(self) -> None: ...

    def transcribe(self, sample: dict[str, Any]) -> dict[str, Any]: ...

    def close(self) -> None: ...


def _failed(sample_id: str | None, stage: str, error: Exception) -> dict[str, Any]:
    failure = {
        "stage": stage,
        "error_type": type(error).__name__,
        "families": [c.__name__ for c in type(error).__mro__ if c not in (BaseException, object)],
        "message": str(error),
        "sample_id": sample_id,
        "error_code": getattr(error, "code", None) if isinstance(getattr(error, "code", None), str) else None,
        "retryable": bool(getattr(error, "retryable", False)),
    }
    return dict(zip(_COLUMNS, (sample_id, "failed", None, None, failure), strict=True))


def _transcribed(backend: Backend, sample: dict[str, Any]) -> dict[str, Any]:
    key, stage = sample["sample_id"], "preflight"
    try:
        if hasattr(backend, "preflight"):
            backend.preflight(sample)
        stage, start = "transcribe", perf_counter()
        answer = backend.transcribe(sample)
        elapsed = perf_counter() - start
        if not isinstance(answer, dict) or not isinstance(answer.get("text"), str):
            raise TypeError("a backend answers with a dict that has a text")
    except Exception as error:  # a bad sample must not end the run
        return _failed(key, stage, error)
    transcript = {name: answer.get(name) for name in ("text", "language", "audio_duration_seconds")}
    transcript["metadata"] = {str(k): str(v) for k, v in (answer.get("metadata") or {}).items()}
    measurement = {
        "elapsed_seconds": elapsed,
        "process_rss_peak_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
        **{name: answer.get(name) for name in ("gpu_peak_allocated_bytes", "gpu_peak_reserved_bytes")},
    }
    return dict(zip(_COLUMNS, (key, "ok", transcript, measurement, None), strict=True))


class _Held:
    """A backend made, loaded and warmed up on the first sample of its partition."""

    def __init__(self, factory: Callable[[], Backend], warmup_runs: int):
        self.factory, self.warmup_runs = factory, warmup_runs
        self.backend: Backend | None = None
        self.broken: tuple[str, Exception] | None = None
        self.begun = False

    def answer(self, sample: dict[str, Any]) -> dict[str, Any]:
        if not self.begun:
            self._begin(sample)
        if self.broken is not None:
            return _failed(sample["sample_id"], *self.broken)
        return _transcribed(self.backend, sample)

    def _begin(self, sample: dict[str, Any]) -> None:
        self.begun, stage = True, "load"
        try:
            self.backend = self.factory()
            self.backend.load()
            stage = "warmup"
            for _ in range(self.warmup_runs):
                self.backend.transcribe(sample)
        except Exception as error:
            self.broken = (stage, error)

    def close(self) -> list[dict[str, Any]]:
        """A row if the backend could not be closed; it belongs to no sample."""
        backend, self.backend = self.backend, None
        try:
            if backend is not None:
                backend.close()
        except Exception as error:
            return [_failed(None, "close", error)]
        return []


def transcribe(
    samples: DataFrame,
    backend_factory: Callable[[], Backend],
    *,
    warmup_runs: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """One result row per sample: a transcript with its measurement, or a failure.

    ``samples`` has sample_id and whatever the backend reads.  ``partitions`` bounds how often the
    backend is loaded; a partition without samples never loads it.  A backend that cannot be made,
    loaded or warmed up fails every row of its partition at that stage.  It is closed in every case,
    and a failure to close is a row of its own without a sample id.  Rows are keyed, so a retried
    task can be upserted.
    """
    if warmup_runs < 0:
        raise ValueError("warmup_runs is 0 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(backend_factory, warmup_runs)
        try:
            for batch in batches:
                yield pd.DataFrame([held.answer(row) for row in batch.to_dict("records")], columns=_COLUMNS)
            closing = held.close()
            if closing:
                yield pd.DataFrame(closing, columns=_COLUMNS)
        finally:
            held.close()

    placed = samples if partitions is None else samples.repartition(partitions, "sample_id")
    return placed.mapInPandas(run, RESULT_SCHEMA)


def fetch_candidates(
    queries: DataFrame, provider_factory: Callable[[], Callable[[str], list[dict[str, Any]]]]
) -> DataFrame:
    """Candidates of each query from a caller's provider, in the provider's order.

    ``queries``: source_key, query_ord, query.  The provider returns dicts with video_id, url, title
    and duration_seconds; one that raises yields a row with only an error.
    """
    schema = (
        "source_key string, query_ord int, query string, position int, video_id string, url string, "
        "title string, duration_seconds double, error_type string, error_message string"
    )
    fields = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = provider_factory()
        for batch in batches:
            rows: list[dict[str, Any]] = []
            for query in batch.to_dict("records"):
                try:
                    found = search(query["query"])
                    rows += [{**query, "position": p, **item} for p, item in enumerate(found)]
                except Exception as error:
                    rows.append({**query, "error_type": type(error).__name__, "error_message": str(error)})
            yield pd.DataFrame(rows, columns=fields)

    return queries.select("source_key", "query_ord", "query").mapInPandas(run, schema)
