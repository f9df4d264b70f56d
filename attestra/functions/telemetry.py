"""What ran and how much came of it, without any text: counts of a DataFrame's rows, and of calls by id."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

try:
    from opentelemetry import trace
except ImportError:
    trace = None

COUNTED = ("gaps", "links", "lineage", "successors", "needs_revalidation", "sentences")
MOST_OF_AN_ID = 256


def observed(df: DataFrame, name: str, flags: tuple[str, ...] = ()) -> tuple[DataFrame, Observation]:
    """``df`` that reports its rows, and how many have each boolean column true, when an action runs; read ``observation.get`` then."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags]), seen


def counts(result: Any) -> dict[str, Any]:
    """Sizes and flags of a call's result: never a text of it."""
    if isinstance(result, list):
        return {"rows": len(result)}
    if not isinstance(result, dict):
        return {}
    held = result["chain"] if isinstance(result.get("chain"), dict) else result
    found = {f"n_{name}": len(held[name]) for name in COUNTED if isinstance(held.get(name), list)}
    if isinstance(held.get("gaps"), list):
        found["blocking"] = ",".join(sorted({g["kind"] for g in held["gaps"] if g.get("blocking")}))
    if isinstance(result.get("grounded"), bool):
        found["grounded"] = result["grounded"]
    return found


def reported(by_id: bool) -> Callable:
    """A method whose calls go to its object's ``on_call`` as a row of operation, subject (the id asked for, if ``by_id``), seconds, error (its type) and counts; and to a tracer, where one is installed. Errors go on unchanged."""

    def decorate(method: Callable) -> Callable:
        @functools.wraps(method)
        def call(self, *args, **named):
            began, row = time.perf_counter(), {"operation": method.__name__}
            if by_id:
                asked = args[0] if args else next(iter(named.values()), None)
                row["subject"] = str(asked)[:MOST_OF_AN_ID]
            try:
                result = method(self, *args, **named)
                row |= counts(result)
                return result
            except Exception as error:
                row["error"] = type(error).__name__
                raise
            finally:
                row["seconds"] = time.perf_counter() - began
                if trace is not None:
                    taken = trace.get_tracer("attestra").start_span(f"attestra.{method.__name__}", start_time=time.time_ns() - int(row["seconds"] * 1e9))
                    taken.set_attributes({f"attestra.{k}": v for k, v in row.items()})
                    taken.end()
                if self.on_call is not None:
                    self.on_call(row)

        return call

    return decorate
