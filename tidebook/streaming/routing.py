"""Routing of messages to subscriptions: a stream joined to the stream of subscriptions that hold at a message's time.

Two streams meet in their state, and each delivery is a row that is written: right for messages that go to few.  Where many
subscriptions hold at once, deliveries grow with the square of the input, so streams are written as they come, once, and
``routed`` joins the two tables when deliveries are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest time that one subscription holds, and how late messages and subscriptions may come.
LONGEST = 86_400
LATE = "1 hour"
#: Seconds of one place of the join.
SLICE = 3600


def routed(messages: DataFrame, subscriptions: DataFrame, late: str = LATE, longest: int = LONGEST) -> DataFrame:
    """(subscription_id, owner, symbol, ts, payload) for each subscription that a message goes to.

    Messages have owner, symbol, ts and payload, subscriptions subscription_id, owner, symbol, valid_from and valid_to (left
    out).  A message goes to every subscription of its own owner with its symbol at its time, never to another owner's;
    one without owner or symbol goes nowhere.  Either side may come first, ``late`` behind its own newest at most; what can
    meet nothing any more leaves the state.  Both meet in slices of time, so a symbol with most messages is spread over tasks.
    Of two tables nothing is late.
    """
    second = lambda c: F.unix_seconds(c)
    end = F.least(F.col("valid_to"), F.col("valid_from") + F.expr(f"INTERVAL {longest} SECONDS"))
    m = messages.where("owner IS NOT NULL AND symbol IS NOT NULL").withWatermark("ts", late)
    m = m.select("owner", "symbol", "ts", "payload", F.floor(second("ts") / SLICE).alias("slice"))
    s = subscriptions.withColumn("until", end).where(F.col("until") > F.col("valid_from")).withWatermark("valid_from", late)
    slices = F.sequence(F.floor(second("valid_from") / SLICE), F.floor(second("until") / SLICE))
    s = s.select("subscription_id", F.col("owner").alias("s_owner"), F.col("symbol").alias("s_symbol"), "valid_from", "until", F.explode(slices).alias("s_slice"))
    same = (F.col("owner") == F.col("s_owner")) & (F.col("symbol") == F.col("s_symbol")) & (F.col("slice") == F.col("s_slice"))
    then = (F.col("ts") >= F.col("valid_from")) & (F.col("ts") < F.col("until")) & (F.col("ts") <= F.col("valid_from") + F.expr(f"INTERVAL {longest} SECONDS"))
    # by shuffle: a few MB of subscriptions, told apart by hours, are too many rows to broadcast
    return m.join(s.hint("merge"), same & then).select("subscription_id", "owner", "symbol", "ts", "payload")
