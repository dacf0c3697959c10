from jobtrail.streaming.run import run_to_end
from jobtrail.streaming.track import (
    activity_changes,
    latest_counts,
    quiet_spells_stream,
    responses_within_stream,
    with_event_time,
)
from jobtrail.streaming.watch import new_keys

__all__ = [
    "activity_changes",
    "latest_counts",
    "new_keys",
    "quiet_spells_stream",
    "responses_within_stream",
    "run_to_end",
    "with_event_time",
]
