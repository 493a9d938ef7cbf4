"""Time-series operators: functions from DataFrames to DataFrames."""

from .asof import asof_join
from .buckets import fill, sample_by, sliding, time_bucket
from .interpolate import interp
from .islands import event_window, session, state_window
from .latest import latest_on
from .rows import csum, derivative, diff, lag, mavg

__all__ = ["asof_join", "csum", "derivative", "diff", "event_window", "fill", "interp", "lag", "latest_on", "mavg", "sample_by", "session", "sliding", "state_window", "time_bucket"]
