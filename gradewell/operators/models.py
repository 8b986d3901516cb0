"""Models as functions of a table: Python callables whose typed errors become attempts, and workers in child processes."""

from __future__ import annotations

import datetime
import json
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gradewell.schemas import OBSERVATION


class ModelTimeout(Exception):
    """The model took too long."""


class ContextOverflow(Exception):
    """The prompt doesn't fit."""


class BudgetExhausted(Exception):
    """A bound of the run is reached."""


class ModelError(Exception):
    """Anything else that is the model's fault."""


#: Errors that become a row; all others end the job.
TYPED = ((ModelTimeout, "timeout"), (ContextOverflow, "context_overflow"), (BudgetExhausted, "budget"), (ModelError, "error"))
OUTPUT = "case_id string, family_id string, raw_output string, failure string"


def calling(model: Callable[[dict], str]) -> Callable[[DataFrame], DataFrame]:
    """A generator for run_or_resume(): model gets each case as a dict and returns a text; what is no text is a model error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for case in batch.to_dict("records"):
                text, failure = None, None
                try:
                    text = model(case)
                except tuple(e for e, _ in TYPED) as error:
                    failure = next(name for kind, name in TYPED if isinstance(error, kind))
                if failure is None and not isinstance(text, str):
                    text, failure = None, "error"
                out.append((case["case_id"], case["family_id"], text, failure))
            yield pd.DataFrame(out, columns=["case_id", "family_id", "raw_output", "failure"])

    return lambda cases: cases.mapInPandas(rows, OUTPUT)


#: Numbers and texts that a worker's envelope must hold, and those it may.
ENVELOPE = {"case_id": str, "raw_output": str, "model_inference_seconds": (int, float), "input_token_count": int, "output_token_count": int, "stop_reason": str, "prompt_sha256": str}
OPTIONAL = ("input_ids", "generated_ids", "runtime_device", "parameter_dtype", "attention_mode", "model_load_seconds")
_FIELDS = [f.partition(":")[0] for f in OBSERVATION[7:-1].replace("array<int>", "x").split(",")]


def _envelope(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    ok = isinstance(found, dict) and not found.keys() - ENVELOPE.keys() - set(OPTIONAL) and all(isinstance(found.get(k), t) and not isinstance(found.get(k), bool) for k, t in ENVELOPE.items())
    return found if ok else None


def run_child(command: list[str], request: str, case_id: str, seconds: float) -> dict:
    """One case in a child process: request on its input, one JSON envelope on its output. Classified as a success, a timeout, a failed
    launch, a bad exit, a bad envelope or another case's answer; what was seen and captured is kept either way."""
    now = lambda: datetime.datetime.now(datetime.timezone.utc).isoformat()
    begun, began = now(), time.monotonic()
    seen = dict.fromkeys(_FIELDS) | {"case_id": case_id, "started_at_utc": begun, "schema_version": "1.1", "transport_status": "execution_error"}
    text, failure, out, err = None, "error", None, None
    try:
        done = subprocess.run(command, input=request, capture_output=True, text=True, encoding="utf-8", timeout=seconds, check=False)
        out, err = done.stdout, done.stderr
        seen["worker_returncode"] = done.returncode
        found = _envelope(out) if done.returncode == 0 else None
        if found and found["case_id"] == case_id:
            text, failure = found.pop("raw_output"), None
            seen |= found | {"transport_status": "completed"}
            out = None  # the envelope is kept as columns
    except subprocess.TimeoutExpired as error:
        failure, seen["transport_status"] = "timeout", "timeout"
        out, err = (x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in (error.stdout, error.stderr))
    except OSError as error:
        err = str(error)
    seen |= {"completed_at_utc": now(), "elapsed_seconds": time.monotonic() - began}
    return {"raw_output": text, "failure": failure, "observation": seen, "worker_stdout": out, "worker_stderr": err or None}


def in_children(command: list[str], request: Callable[[dict], str], seconds: float) -> Callable[[DataFrame], DataFrame]:
    """A generator that runs each case by run_child(); returns OUTPUT with observation and diagnostics."""
    schema = f"{OUTPUT}, observation {OBSERVATION}, worker_stdout string, worker_stderr string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [{"case_id": c["case_id"], "family_id": c["family_id"]} | run_child(command, request(c), c["case_id"], seconds) for c in batch.to_dict("records")]
            yield pd.DataFrame(out, columns=["case_id", "family_id", "raw_output", "failure", "observation", "worker_stdout", "worker_stderr"])

    return lambda cases: cases.mapInPandas(rows, schema)
