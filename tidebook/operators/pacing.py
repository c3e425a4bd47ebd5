"""Paced admission and capped recordings: limits over a whole ordered stream, by distributed running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.scans import SLICE, micros, running, sliced

#: Most admissions within a sliding window of so many seconds.
LIMIT, SECONDS = 50, 600
#: Most frames of a recording, and most closes in its bar frames.
FRAMES, CLOSES = 5_000, 2_000_000


def admissions(requests: DataFrame, order: list[str], arrival: str = "arrival", by: list[str] | None = None, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """Requests with ``admitted``: first come, first served, at most ``limit`` within any ``seconds``.

    Request i of a queue is admitted at its arrival or, if later, so many seconds after request i - limit was.  Within the
    requests of one residue of i that is a running maximum of arrival - seconds * (number in the residue), so no request waits
    for the one before to be worked out.  ``order`` gives the queue's order and settles ties, its first column a number or time;
    arrivals (timestamps without time zone) must not fall in it.  Each key of ``by`` has a queue of its own.
    """
    by = list(by or ())
    step = seconds * 1_000_000
    queue = running(sliced(requests, order[0]), order, {"i_": ("count", F.lit(1))}, by)
    k = F.floor((F.col("i_") - 1) / limit)
    placed = queue.withColumn("class_", (F.col("i_") - 1) % limit).withColumn("k_", k)
    early = micros(F.col(arrival)) - F.col("k_") * step
    late = running(placed, order, {"m_": ("max", early)}, [*by, "class_"])
    wait = F.col("m_") + F.col("k_") * step - micros(F.col(arrival))
    return late.withColumn("admitted", F.col(arrival) + F.make_dt_interval(secs=(wait / 1_000_000).cast("decimal(18,6)"))).select(*requests.columns, "admitted")


def recorded(events: DataFrame, at: str = "d", frames: int = FRAMES, closes: int = CLOSES) -> DataFrame:
    """Which sessions of a replay a recording keeps: ``at``, session, eventful, keep, keep_bars, closes, kept_closes.

    ``events`` has a row per symbol and event (``bar``, ``signal``, ``fill``).  Beyond ``frames`` sessions only every n-th is kept,
    and of those that are, beyond ``closes`` closes in all, only every m-th has its bars; sessions with a signal or
    fill, and the last, stay whole.  ``kept_closes`` is the running total of closes that are kept.
    """
    eventful = F.bool_or(F.col("event").isin("signal", "fill"))
    sessions = events.groupBy(at).agg(eventful.alias("eventful"), F.count(F.when(F.col("event") == "bar", 1)).alias("closes"))
    size = sessions.agg(F.count("*").alias("n_"), F.max(at).alias("last_"))
    symbols = events.agg(F.count_distinct("symbol").alias("symbols_"))
    numbered = running(sliced(sessions, at), [at], {"session": ("count", F.lit(1))}).withColumn("session", F.col("session") - 1)
    every = F.ceil(F.col("n_") / frames)
    bars_every = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n_") / F.col("every_")) * F.greatest(F.lit(1), F.col("symbols_")) / closes))
    one_row = size.crossJoin(symbols).withColumn("every_", every).withColumn("bars_every_", bars_every)
    known = numbered.crossJoin(F.broadcast(one_row)).withColumn("eventful", F.col("eventful") | (F.col(at) == F.col("last_")))
    kept = known.withColumn("keep", F.col("eventful") | (F.col("session") % F.col("every_") == 0)).withColumn(
        "keep_bars", F.col("eventful") | (F.col("keep") & (F.floor(F.col("session") / F.col("every_")) % F.col("bars_every_") == 0))
    )
    total = running(kept, [at], {"kept_closes": ("sum", F.when(F.col("keep_bars"), F.col("closes")).otherwise(0))})
    return total.select(at, "session", "eventful", "keep", "keep_bars", "closes", "kept_closes")


def record_steps(sessions: int, symbols: int, frames: int = FRAMES, closes: int = CLOSES) -> tuple[int, int]:
    """(n, m) of ``recorded`` for a replay of known size."""
    every = max(1, -(-sessions // frames))
    return every, max(1, -(-(-(-sessions // every) * max(1, symbols)) // closes))


__all__ = ["SLICE", "admissions", "record_steps", "recorded"]
