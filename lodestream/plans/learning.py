"""Registered queries of models that are fitted window by window, many series at once. Tests hold them against plain computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.operators import baskets as bk
from lodestream.operators import features as ft
from lodestream.operators import hidden as hd
from lodestream.operators import learning as ln
from lodestream.operators import signals as sg
from lodestream.operators import volatility as vo
from lodestream.plans.market import TS
from lodestream.plans.regimes import STATE
from lodestream.plans.registry import query
from lodestream.streaming import regimes as sr


@query("s12_21_hidden_regimes")
def _(spark, d):
    return hd.regimes(hd.observations(v.bars(spark, d)), train=240, test=60)


@query("s12_21_regime_stays")
def _(spark, d):
    return hd.stays(hd.regimes(hd.observations(v.bars(spark, d)), train=240, test=60))


@query("s11_17_hidden_reversion")
def _(spark, d):
    bars = v.bars(spark, d)
    rows = sg.mean_reversion(bars).select("symbol", "ts", "close", "sig")
    return hd.gate(rows, hd.regimes(hd.observations(bars), train=240, test=60)).select("symbol", "ts", "sig", "calm", "gated")


FEATURES = ("rsi", "bb_width", "vol", "ret_1", "ret_5", "vol_ratio", "gap")


def _dataset(spark, d):
    """Bars with features, the sign of the next six hours' return as label, and when it is known."""
    w = ft.series()
    x = ft.feature_table(v.bars(spark, d)).withColumns({"gap": F.col("ema_9") / F.col("ema_50") - 1, "fwd": F.lead("close").over(w) / F.col("close") - 1, "t1": F.lead("ts", 6).over(w), "_f": F.lead("close", 6).over(w)})
    return x.dropna(subset=["t1", *FEATURES]).withColumn("label", F.when(F.col("_f") > F.col("close"), 1).otherwise(-1)).select("symbol", "ts", "t1", "label", "fwd", *FEATURES)


@query("s12_13_walk_forward_classifier")
def _(spark, d):
    w = ft.series()
    x = v.bars(spark, d).withColumn("r1", ft.ret("close")).withColumn("z", ft.zscore("close", 24)).withColumn("vr", F.col("volume") / F.nullif(ft.sma("volume", 20), F.lit(0.0)))
    x = x.withColumn("y", (F.lead("close").over(w) > F.col("close")).cast("int")).dropna(subset=["r1", "z", "vr"])
    return ln.walk_forward(x, ["r1", "z", "vr"], "y", 240, 120, 2)


@query("s12_14_meta_labels")
def _(spark, d):
    return ln.meta_labels(_dataset(spark, d), FEATURES, "label", 300, 100, forward="fwd", fee=0.001)


@query("s11_19_model_signal")
def _(spark, d):
    return ln.model_signal(ln.meta_labels(_dataset(spark, d), FEATURES, "label", 300, 100), "p_meta", "side", step=0.1)


@query("s12_17_tree_importance")
def _(spark, d):
    return ln.importance(ln.fold_scores(_dataset(spark, d), FEATURES, "label", 400))


@query("s12_19_clustered_importance")
def _(spark, d):
    return ln.clustered(ln.fold_scores(_dataset(spark, d), FEATURES, "label", 400))


@query("s12_18_component_agreement")
def _(spark, d):
    x = _dataset(spark, d)
    return ln.component_agreement(x, ln.importance(ln.fold_scores(x, FEATURES, "label", 400)), FEATURES)


@query("s12_22_exponential_garch")
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", ft.log_ret("close"))
    return vo.exponential_garch(x, "r", 240, 60).select("symbol", "ts", "window", "vol")


def _baskets(spark, d):
    """Baskets of three neighbouring symbols, eight of them."""
    names = v.bars(spark, d).select("symbol").distinct()
    first = names.select(F.col("symbol").alias("basket"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    return first.select("basket", F.concat(F.lit("S"), (F.substring("basket", 2, 9).cast("int") + F.col("k")) % 8).alias("symbol"))


@query("s11_18_sparse_baskets")
def _(spark, d):
    panel = bk.panels(v.bars(spark, d), _baskets(spark, d))
    return bk.spreads(panel, 60, 2).select("basket", "ts", "window", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), "spread", "half_life")


@query("s11_18_basket_positions")
def _(spark, d):
    return bk.positions(bk.spreads(bk.panels(v.bars(spark, d), _baskets(spark, d)), 60, 2), 60, enter=1.5)


@query("s10_11_stream_regimes", STATE + f" SELECT symbol, {TS}, round(strength, 6) AS strength, structure, vol, label FROM st")
def _(spark, d):
    return sr.run_over(v.bars(spark, d), "stream-regimes")
