"""Handlers: per (event type, version) error expressions, dispatched by one CASE.

A handler is a function ``DataFrame columns -> Column`` returning the error text
(NULL on success) and its error class. Native handlers stay inside whole-stage
codegen. ``python_handler`` wraps a per-row Python function in an Arrow-batched
pandas UDF and turns an exception in one row into a retriable ``panic: ...``
failure of that row only.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import constants as K
from sluice.operators import parse as P

HANDLER_RESULT = T.StructType([T.StructField("error_class", T.StringType()),
                               T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Handler:
    """``check`` returns a struct<error_class, error>; the event succeeds when ``error`` (or the struct) is NULL.

    A ``python_handler`` takes the rows it may run on as a column: a ``CASE`` around a
    Python function does not keep other rows from it.
    """
    name: str
    check: Callable[..., Column]

    def result(self, mine: Column) -> Column:
        return self.check(mine) if getattr(self.check, "masked", False) else F.when(mine, self.check())


def _business(err: Column) -> Column:
    # the class is only read where ``error`` is not NULL (see apply_handlers), so err appears once
    return F.struct(F.lit(K.EC_BUSINESS).alias("error_class"), err.alias("error"))


def visit_approved() -> Column:
    d = F.col("data")
    err = P.payload_error(d, P.VISIT_FIELDS, K.VISIT_STRUCT, K.VISIT_TYPE)
    return _business(F.when(err.isNotNull(), F.concat(F.lit(K.BUSINESS + "invalid VISIT_APPROVED data: "), err)))


def notification_triggered() -> Column:
    d = F.col("data")
    err = P.payload_error(d, P.NOTIFICATION_FIELDS, K.NOTIFICATION_STRUCT, K.NOTIFICATION_TYPE)
    return _business(F.when(err.isNotNull(),
                            F.concat(F.lit(K.BUSINESS + "invalid NOTIFICATION_TRIGGERED data: "), err)))


DEFAULT_HANDLERS: dict[str, Handler] = {
    "VISIT_APPROVED": Handler("VISIT_APPROVED", visit_approved),
    "NOTIFICATION_TRIGGERED": Handler("NOTIFICATION_TRIGGERED", notification_triggered),
}

# --- fixed values: texts of injected failures (fixture side column ``fault``) --
FAULT_PANIC_TEXT = "panic: simulated handler panic"
FAULT_ERROR_TEXT = "simulated handler error: downstream unavailable"


def split_python(handlers: Mapping[str, Handler] | None) -> tuple[dict[str, Handler], dict[str, Handler]]:
    """(handlers with the Python ones left out of the expressions, the Python ones)."""
    every = dict(handlers or DEFAULT_HANDLERS)
    python = {n: h for n, h in every.items() if getattr(h.check, "masked", False)}
    none = Handler("none", lambda: F.lit(None).cast(HANDLER_RESULT))
    return {n: none if n in python else h for n, h in every.items()}, python


def register_handler(handlers: Mapping[tuple[str, int], Handler], event_type: str, version: int,
                     handler: Handler) -> dict[tuple[str, int], Handler]:
    """Add a handler for (event_type, version); registering the same pair twice is an error."""
    key = (event_type, int(version))
    if key in handlers:
        raise ValueError(f"registry: duplicate processor for {event_type} v{version}")
    out = dict(handlers)
    out[key] = handler
    return out


def registry_of(spark, handlers: Mapping[tuple[str, int], Handler]):
    """(registry frame for the lookup join, handlers by processor name for ``apply_handlers``)."""
    from sluice.operators.route import registry_frame
    frame = registry_frame(spark, list(handlers), {k: h.name for k, h in handlers.items()})
    return frame, {h.name: h for h in handlers.values()}


def inject_faults(result: Column, fault: Column) -> Column:
    """A decoded payload may still fail in the handler's downstream call (fixture fault column).

    ``result`` must be a column reference (it is read twice).
    """
    injected = (F.when(fault == "panic", F.struct(F.lit(K.EC_PANIC).alias("error_class"),
                                                  F.lit(FAULT_PANIC_TEXT).alias("error")))
                .when(fault == "error", F.struct(F.lit(K.EC_ERROR).alias("error_class"),
                                                 F.lit(FAULT_ERROR_TEXT).alias("error"))))
    return F.when(result["error"].isNotNull(), result).otherwise(injected)


def check_handlers(registry: DataFrame, handlers: Mapping[str, Handler] | None = None) -> None:
    """A registered processor that no handler implements is a wiring error: raise before any event is read."""
    named = {r["processor"] for r in registry.select("processor").distinct().collect()}
    missing = sorted(n for n in named - set(handlers or DEFAULT_HANDLERS) if n is not None)
    if missing:
        raise ValueError(f"registry: no handler for {', '.join(missing)}")


def apply_handlers(events: DataFrame, handlers: Mapping[str, Handler] | None = None,
                   fault_col: str | None = None, where: Column | None = None) -> DataFrame:
    """Run the handler of each row's ``processor``; adds ``error_class`` and ``error``.

    Rows failing ``where`` reach no handler.
    """
    hs = handlers or DEFAULT_HANDLERS
    res = F.lit(None).cast(HANDLER_RESULT)
    for name, h in hs.items():
        mine = F.col("processor") == name
        if where is not None:
            mine = mine & where
        res = F.when(mine, h.result(F.coalesce(mine, F.lit(False)))).otherwise(res)
    from sluice.functions.strict_json import computed_once
    df = events.withColumn("_h", computed_once(res))
    if fault_col:
        df = df.withColumn("_h", F.when(F.col("processor").isNotNull(),
                                        inject_faults(F.col("_h"), F.col(fault_col))))
    err = F.col("_h.error")
    return (df.withColumns({"error_class": F.when(err.isNotNull(), F.col("_h.error_class")), "error": err})
            .drop("_h"))


def python_handler(fn: Callable[[dict], None], columns: list[str]) -> Callable[..., Column]:
    """Wrap a per-row Python handler ``fn(row_dict)`` (raise = failure) as a pandas UDF.

    ``BusinessError`` raised by ``fn`` is final; any other exception becomes a
    retriable ``panic: <message>`` for that row only. ``run_triage`` calls ``fn`` as a worker would, on
    claimed rows only (``execute.run_claimed``). As a column, as in ``apply_handlers`` and the stream, it sees all valid, routed rows of
    its processor, repeats of an event included, so it must be safe to run again there.
    """

    @F.pandas_udf(HANDLER_RESULT)
    def run(mine: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        cls, err = [None] * n, [None] * n
        own = mine.to_numpy(dtype=bool).nonzero()[0]
        for i, row in zip(own, rows.iloc[own].to_dict("records")):
            try:
                fn(row)
            except BusinessError as e:
                cls[i], err[i] = K.EC_BUSINESS, K.BUSINESS + str(e)
            except Exception as e:  # noqa: BLE001 -- per-row isolation is the point
                cls[i], err[i] = K.EC_PANIC, K.PANIC + str(e)
        return pd.DataFrame({"error_class": cls, "error": err})

    def check(mine: Column) -> Column:
        return run(mine, F.struct(*[F.col(c) for c in columns]))
    check.masked, check.fn, check.columns = True, fn, list(columns)
    return check


class BusinessError(Exception):
    """Final (non-retriable) handler failure."""
