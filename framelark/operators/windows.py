"""Sliding windows of a fixed number of messages and their features.

A capture is cut into stretches of positions; the first window - 1 messages of
a stretch also go to the stretch before it, so that every window lies within
one stretch and a long capture is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import DEFAULT_GROUPS, features, helpers, moments
from .stream import SLICE_US, WINDOW, positions, recurrence

STRETCH = 8192
#: Up to so many messages of chosen windows are broadcast.
BROADCAST = 1_000_000


def frames(placed: DataFrame, fields: list[str], window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """capture, pos, frame: the structs of ``fields`` of the ``window`` messages from pos on; full windows only."""
    own = F.floor(F.col("pos") / stretch)
    shared = (F.col("pos") % stretch < window - 1) & (own > 0)
    rows = placed.withColumn("stretch", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    ahead = Window.partitionBy("capture", "stretch").orderBy("pos").rowsBetween(0, window - 1)
    framed = rows.select("capture", "stretch", "pos", F.collect_list(F.struct(*fields)).over(ahead).alias("frame"))
    return framed.where((F.size("frame") == window) & (F.floor(F.col("pos") / stretch) == F.col("stretch"))).drop("stretch")


def window_features(messages: DataFrame, groups=DEFAULT_GROUPS, window: int = WINDOW, slice_us: int = SLICE_US, starts: DataFrame | None = None, order: str = "seq", most: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """capture, pos, the features of ``groups``, y (1 if a message of the window has a label above 0).

    ``messages``: capture, t_us, can_id, dlc, label and ``order``.  With ``starts``
    (capture, pos and more), only windows that start there, its columns kept; if they
    are at most ``most``, only their messages are framed.  ``known``: the ``slices`` of
    the messages, if at hand.
    """
    needs_dt = "temporal_id" in groups
    timed = recurrence(messages, slice_us, order, known) if needs_dt else messages.withColumn("dt_us", F.lit(None).cast("long"))
    placed = positions(timed, slice_us, order, messages, known)
    if starts is not None and most is not None:  # the messages of a start stay next to each other
        wanted = starts.select("capture", F.explode(F.sequence(F.col("pos"), F.col("pos") + window - 1)).alias("pos")).distinct()
        placed = placed.join(F.broadcast(wanted) if most * window <= BROADCAST else wanted, ["capture", "pos"], "left_semi")
    made = frames(placed, ["t_us", "can_id", "dlc", "label", "dt_us"], window)
    kept = [c for c in starts.columns if c not in ("capture", "pos")] if starts is not None else []
    if starts is not None:
        made = made.join(starts, ["capture", "pos"])
    told = made.select("capture", "pos", *kept, *[v.alias(k) for k, v in helpers(F.col("frame")).items()])
    told = told.select("*", *[v.alias(k) for k, v in moments().items()])
    finite = lambda x: F.when(F.isnan(x) | F.isnull(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return told.select("capture", "pos", *kept, *[finite(v).alias(k) for k, v in features(window, groups).items()], "y")
