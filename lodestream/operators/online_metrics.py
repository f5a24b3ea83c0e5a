"""Funnel, session and serving figures from logged rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordering import sessions


def _ratio(top, bottom):
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def funnel_counts():
    """Impressions are views, conversions purchases and conversions, engagements all but views."""
    kind = F.col("action_type")
    return [
        F.count_if(kind == "View").alias("impressions"),
        F.count_if(kind == "Click").alias("clicks"),
        F.count_if(kind.isin("Purchase", "Convert")).alias("conversions"),
        F.count_if(kind != "View").alias("engagements"),
    ]


def funnel_rates():
    """A rate is 0 when its denominator is 0; conversions are per click."""
    return [
        _ratio(F.col("clicks"), F.col("impressions")).alias("click_through_rate"),
        _ratio(F.col("conversions"), F.col("clicks")).alias("conversion_rate"),
        _ratio(F.col("engagements"), F.col("impressions")).alias("engagement_rate"),
    ]


def online_metrics(actions: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """One row of rates; sessions are split at gaps and a one-event session is a bounce."""
    funnel = actions.agg(*funnel_counts()).select(*funnel_rates())
    visits = sessions(actions, "user_id", "ts", gap_minutes).agg(
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("session_length"),
        _ratio(F.count_if("bounced"), F.count("*")).alias("bounce_rate"),
    )
    # both sides are single aggregate rows; the sessions are built once
    both = funnel.withColumn("_visits", visits.select(F.struct("session_length", "bounce_rate")).scalar())
    return both.select("*", "_visits.session_length", "_visits.bounce_rate").drop("_visits")


def windowed_funnel(actions: DataFrame, width: str = "1 day") -> DataFrame:
    """Funnel rates by tumbling window: a window takes the place of a counter reset."""
    return (
        actions.groupBy(F.window("ts", width).alias("w"))
        .agg(*funnel_counts())
        .select(F.col("w.start").alias("window_start"), "impressions", "clicks", "conversions", *funnel_rates())
    )


def serving_stats(requests: DataFrame) -> DataFrame:
    """(stat, value) over a request log (failed, latency_ms).

    The average is the floor of the true mean, not a running integer update
    that rounds at every request.
    """
    totals = requests.agg(
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("failed")).alias("successful_requests"),
        F.count_if("failed").alias("failed_requests"),
        F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).cast("bigint").alias("avg_latency_ms"),
        F.coalesce(F.max("latency_ms"), F.lit(0)).cast("bigint").alias("max_latency_ms"),
    )
    return totals.unpivot([], totals.columns, "stat", "value")
