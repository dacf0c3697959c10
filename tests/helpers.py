from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)
LOG = "event_id bigint, ts timestamp_ntz, application_id bigint, status string"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=str)


def plan_of(df) -> str:
    """The physical plan as text; an adaptive plan is shown as it was before it ran."""
    return df._jdf.queryExecution().executedPlan().toString()
