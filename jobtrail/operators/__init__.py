from jobtrail.operators.apply import application_payload, apply_queue, sent_events
from jobtrail.operators.nearest import cell_bounds, deal_cells, fit_centres, nearest, probe, units
from jobtrail.operators.score import (
    blend_scores,
    keyword_score,
    keyword_weights,
    preference_filter,
    top_roles,
    vector_score,
)
from jobtrail.operators.search import bucket_bounds, posting_weights, search_roles
from jobtrail.operators.seen import marked_keys, merged_sketch, new_by_sketch, seen_sketch
from jobtrail.operators.sketches import (
    application_report,
    application_sketches,
    daily_applications,
    daily_durations,
    duration_quantiles,
    duration_sketches,
    exact_quantiles,
    exact_report,
)
from jobtrail.operators.tailor import (
    assemble_resume,
    by_role,
    cover_fragments,
    cover_matched,
    coverage_gap,
    fragment_words,
    gap_matched,
    matched_words,
    rank_fragments,
    rank_matched,
)
from jobtrail.operators.track import (
    activity_windows,
    current_status,
    quiet_spells,
    response_pairs,
    responses_within,
    stage_funnel,
    stale_applications,
    status_history,
    status_report,
)
from jobtrail.operators.watch import (
    new_roles,
    own_content,
    page_fields,
    page_key,
    page_lines,
    page_roles,
    site_activity,
    site_lines,
    snapshot_diff,
)

__all__ = [
    "activity_windows",
    "application_payload",
    "application_report",
    "application_sketches",
    "apply_queue",
    "assemble_resume",
    "blend_scores",
    "bucket_bounds",
    "by_role",
    "cell_bounds",
    "cover_fragments",
    "cover_matched",
    "coverage_gap",
    "current_status",
    "daily_applications",
    "daily_durations",
    "deal_cells",
    "duration_quantiles",
    "duration_sketches",
    "exact_quantiles",
    "exact_report",
    "fit_centres",
    "fragment_words",
    "gap_matched",
    "keyword_score",
    "keyword_weights",
    "marked_keys",
    "matched_words",
    "merged_sketch",
    "nearest",
    "new_by_sketch",
    "new_roles",
    "own_content",
    "page_fields",
    "page_key",
    "page_lines",
    "page_roles",
    "posting_weights",
    "preference_filter",
    "probe",
    "quiet_spells",
    "rank_fragments",
    "rank_matched",
    "response_pairs",
    "responses_within",
    "search_roles",
    "seen_sketch",
    "sent_events",
    "site_activity",
    "site_lines",
    "snapshot_diff",
    "stage_funnel",
    "stale_applications",
    "status_history",
    "status_report",
    "top_roles",
    "units",
    "vector_score",
]
