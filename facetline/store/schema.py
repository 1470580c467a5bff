"""The eight tables and what refers to what."""

from __future__ import annotations

TABLES = {
    "video_metadata": "id string, path string, indexed_at timestamp",
    "identities": "id int, name string, created_at timestamp",
    "variants": "id int, identity_id int, name string, embedding array<float>, face_count int, created_at timestamp",
    "face_intervals": "id long, video_id string, start_time double, end_time double, face_count int, variant_id int",
    "ledger_entries": "id long, commit_id string, track_id string, variant_id int, added_sum array<float>, added_count int, created_at timestamp",
    "commits": "id string, status string, created_at timestamp",
    "commit_video_snapshots": "commit_id string, video_id string, had_metadata boolean, previous_path string, previous_indexed_at timestamp",
    "commit_interval_snapshots": "id long, commit_id string, video_id string, start_time double, end_time double, face_count int, variant_id int",
}
#: (child, foreign key, parent) whose rows go with the parent's, parents first.
CASCADES = [
    ("variants", "identity_id", "identities"),
    ("face_intervals", "variant_id", "variants"),
    ("ledger_entries", "variant_id", "variants"),
    ("commit_interval_snapshots", "variant_id", "variants"),
    ("commit_video_snapshots", "commit_id", "commits"),
    ("commit_interval_snapshots", "commit_id", "commits"),
]
