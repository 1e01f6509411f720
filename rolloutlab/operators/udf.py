"""User-function surface (U1): run a caller's row function inside Spark tasks
with per-row fault isolation.

Each Python worker keeps one supervised child process: it runs ``setup`` once,
for all tasks of the worker, and then one row after the other. A row whose call
raises, runs over the time limit or ends the process gets the default score and
an error text; the child is then replaced and the other rows keep their scores.
Run it after the cheap filters, so the Python path only sees surviving rows.
"""

from __future__ import annotations

import atexit
import multiprocessing
import os
import pickle
import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT = -1.0


def _serve(pipe, code: bytes) -> None:
    """The child: set up once, then answer rows with (score, error)."""
    try:
        fn, setup = cloudpickle.loads(code)
        args = () if setup is None else (setup(),)
    except BaseException as e:
        pipe.send(("setup", f"{type(e).__name__}: {e}"))
        return
    pipe.send(("ready", None))
    while True:
        try:
            row = pickle.loads(pipe.recv_bytes())
        except EOFError:
            os._exit(0)
        try:
            pipe.send((float(fn(row, *args)), None))
        except Exception as e:  # one bad row must not fail the task
            pipe.send((None, f"{type(e).__name__}: {e}"))


class Supervised:
    """A child process that calls a function under a time limit and is replaced when a call overruns it or kills it."""

    def __init__(self, code: bytes, limit: float | None):
        self.code, self.limit, self.process, self.pipe = code, limit, None, None
        self.starts = 0

    def start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(theirs, self.code), daemon=True)
        self.process.start()
        theirs.close()
        self.starts += 1
        kind, error = self.pipe.recv()
        if kind == "setup":                        # a set-up that fails is the caller's error, not a row's
            self.stop()
            raise RuntimeError(f"setup failed: {error}")

    def stop(self) -> None:
        if self.process is not None:
            self.pipe.close()
            self.process.kill()
            self.process.join()
            self.process = None

    def call(self, row: dict) -> tuple[float | None, str | None]:
        if self.process is None:
            self.start()
        try:
            self.pipe.send_bytes(pickle.dumps(row))
            if self.limit is not None and not self.pipe.poll(self.limit):
                self.stop()
                return None, f"TimeoutError: over {self.limit:g} s"
            return self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.process.join()
            code = self.process.exitcode
            self.stop()
            return None, f"ProcessError: exit code {code}"


def _worker_child(code: bytes, limit: float | None) -> Supervised:
    """This Python worker's child for a function: it outlives tasks and ends with the worker, or when another function comes."""
    holder = sys.modules.setdefault("_rolloutlab_worker", types.ModuleType("_rolloutlab_worker"))
    have = getattr(holder, "child", None)
    if have is None or (have.code, have.limit, holder.owner) != (code, limit, os.getpid()):
        if have is not None and holder.owner == os.getpid():
            have.stop()
        holder.child, holder.owner = Supervised(code, limit), os.getpid()
        atexit.register(holder.child.stop)
    return holder.child


def safe_apply(df: DataFrame, fn: Callable[[dict], float], default: float = DEFAULT, out: str = "score",
               setup: Callable[[], object] | None = None, limit: float | None = None) -> DataFrame:
    """Adds ``out`` (double) and ``error`` (string, null on success).

    ``fn(row_dict)`` -- or ``fn(row_dict, ctx)`` when ``setup`` is given, with ``ctx = setup()`` made once per worker
    (and again after a call that had to be ended) -- returns a number. ``limit`` is the most seconds a call may take."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()),
                           T.StructField("error", T.StringType())])
    cols = df.columns
    code = cloudpickle.dumps((fn, setup))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = _worker_child(code, limit)
        for pdf in batches:
            scored = [child.call(rec) for rec in pdf[cols].to_dict("records")]
            yield pdf.assign(**{out: [default if error is not None else score for score, error in scored], "error": [e for _, e in scored]})

    return df.mapInPandas(run, schema)
