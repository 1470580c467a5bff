"""Constants that define behaviour: fixed values."""

EMBEDDING_DIM = 512
MATCH_THRESHOLD = 0.6  # strict
REGROUP_THRESHOLD = 0.35  # inclusive
STRONG_THRESHOLD = 0.25  # inclusive
AMBIGUITY_MARGIN = 0.05  # strict
MOVE_MARGIN = 0.03
REFINEMENT_ROUNDS = 3
SAMPLE_DELTA = 0.10
SAMPLE_FLOOR = 0.001
TOP_FRAMES = 10
BOX_SCALE = 1.2
GRACE_SECONDS, BLIP_SECONDS, LINGER_SECONDS = 2.0, 0.1, 1.0
ACTIONS = ("merge", "new_identity", "new_variant", "discard")
LINKS = ("NEW", "STRONG", "POSSIBLE", "AMBIGUOUS")
COMMIT_STATUSES = ("processing", "active", "rolling_back", "rolled_back", "failed")
