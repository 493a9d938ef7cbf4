"""Live data with Structured Streaming: subscriptions, windows with watermarks, stateful windows, forwarding."""

from .live import Forwarder, deliver, event_windows, live_buckets, live_sessions, source, state_windows, subscribe, unsubscribe

__all__ = ["Forwarder", "deliver", "event_windows", "live_buckets", "live_sessions", "source", "state_windows", "subscribe", "unsubscribe"]
