"""Lookbacks read from plans: against the first bar on which a rule speaks, and wrong declarations refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebook.functions import reach as X
from tidebook.functions import rules as S
from tidebook.functions import windows as W
from tidebook.sources import views as V


@pytest.fixture(scope="module")
def bars(spark, small):
    return V.daily_bars(spark, small)


def test_rows_of_plain_columns(bars):
    w = W.series()
    df = bars.withColumn("a", F.lag("c", 3).over(w)).withColumn("b", W.sma(F.col("a"), 5, w)).withColumn("c2", F.col("b") + F.lag("b").over(w) + F.col("h"))
    df = df.withColumn("total", F.sum("c").over(w)).withColumn("one", F.col("o") * 2).withColumn("prior", F.avg("a").over(w.rowsBetween(-9, -1)))
    assert {c: X.rows_back(df, c) for c in ("o", "a", "b", "c2", "total", "one", "prior")} == {"o": 0, "a": 3, "b": 7, "c2": 8, "total": 0, "one": 0, "prior": 12}


RECURRENT = ("ema_crossover", "rsi_threshold", "adx_trend", "macd_crossover", "macd_slope", "rsi_zone")


@pytest.mark.parametrize("name", RECURRENT)
def test_no_recurrent_rule_speaks_before_it_has_what_it_needs(bars, name):
    declared, least = X.check(bars, name)
    assert 1 < least <= declared
    df, direction, _ = S.RULES[name].build(bars.withColumn("n_", F.row_number().over(W.series())), **S.RULES[name].params())
    spoke = df.withColumn("direction_", direction).where("direction_ IS NOT NULL").agg(F.min("n_")).first()[0]
    assert spoke is None or spoke >= least


@pytest.mark.parametrize("name", sorted(set(S.RULES) - set(RECURRENT)))
def test_a_rule_says_the_same_with_only_the_bars_it_needs(bars, name):
    declared, least = X.check(bars, name)
    assert 1 < least <= declared
    own = S.RULES[name]
    numbered = bars.where("symbol = '1-URGENT'").withColumn("n_", F.row_number().over(W.series())).persist()

    def said(df):
        df, direction, _ = own.build(df, **own.params())
        return df.select("n_", direction.alias("x"))

    whole = {r.n_: r.x for r in said(numbered).where("n_ BETWEEN 100 AND 140").collect()}
    # each stretch of bars is a symbol of its own
    cut = numbered.withColumn("at", F.explode(F.sequence(F.lit(100), F.lit(140)))).where((F.col("n_") <= F.col("at")) & (F.col("n_") > F.col("at") - least))
    df, direction, _ = own.build(cut.withColumn("symbol", F.col("at").cast("string")), **own.params())
    got = {r.n_: r.x for r in df.select("n_", "at", direction.alias("x")).where("n_ = at").collect()}
    assert got == whole


def test_parameters_count(bars):
    assert X.needed(bars, "sma_crossover", fast=5, slow=9) == 10
    assert X.needed(bars, "stochastic_threshold", use_d=True) == 17
    assert X.needed(bars, "macd_crossover", fast=3, slow=6, signal=4) == 10


def test_a_short_declaration_is_refused(bars, monkeypatch):
    monkeypatch.setattr(S, "RULES", dict(S.RULES))

    @S.rule("hasty", "entry", lookback=lambda n: n, n=20)
    def _hasty(df, n):
        w = W.series()
        df = df.withColumn("x", W.sma(F.col("c"), n, w))
        return df, W.crosses(F.col("x"), w), F.col("x")

    with pytest.raises(ValueError, match="hasty declares a lookback of 20 bars and needs 21"):
        X.check(bars, "hasty")
