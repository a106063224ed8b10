"""Thresholds, weights and vocabularies. Values that a result depends on are stated here once."""

from __future__ import annotations

# Evidence thresholds.
PRESENT_MODEL, PRESENT_DIRECT, ABSENT = 0.8, 0.9, 0.8
#: Sources whose confidence is calibrated, for which the lower threshold holds; pass the names of your own models.
MODEL_SOURCES = ("model", "vision")
TASTE_CONFIDENCE = 0.45
TRAIT_CONFIDENCE, MAX_TRAITS, MAX_BULLETS = 0.65, 4, 6

# Popularity prior, score weights, limits.
PRIOR_RATING, PRIOR_VOTES = 4.2, 50
RECOMMEND_LIMIT, SEARCH_LIMIT, SEED_LIMIT, PAGE, PER_AUTHOR = 12, 24, 60, 24, 2
MECHANIC_BONUS, MECHANIC_CAP = 0.02, 2
UNNUMBERED = 9999

# Dates and ages.
FRESH_ONGOING_DAYS, FRESH_COMPLETE_DAYS = 7, 180
ADULT_AGE, OLDEST_AGE = 18, 120
FIRST_YEAR, YEARS_AHEAD = 1900, 3
SESSION_SECONDS, STATE_SECONDS = 30 * 24 * 3600, 600
MAX_BODY, MAX_IMPORT, LOG_TAIL = 512 * 1024, 5_000_000, 8192

# Vocabularies, in their natural order.
STATUSES = ("want", "reading", "read", "paused")
RESERVED_IDS = ("__proto__", "constructor", "prototype")
SAFE_ID = r"^[A-Za-z0-9._:-]{1,128}\z"
FILTERS = {  # filter -> content signal it looks at
    "hideSexualized": "sexualized", "hideExplicit": "explicit", "hideHarem": "harem",
    "hideAiNarration": "aiNarration", "hideAiWriting": "aiWriting", "hideQualityFlags": "quality",
}
DEFAULT_FILTERS = {
    "hideSexualized": True, "hideExplicit": True, "hideHarem": True, "hideAiNarration": True,
    "hideAiWriting": True, "hideQualityFlags": False, "hideUnknown": False,
}
GATED_FILTERS = ("hideSexualized", "hideExplicit")
TASTES = {
    "stats": "Crunchy stats", "action": "Action", "humor": "Humor", "cozy": "Cozy vibes",
    "worldbuilding": "Worldbuilding", "crafting": "Crafting & building", "politics": "Schemes & politics", "teamwork": "Found family",
}
GENRES = {
    "litrpg": "LitRPG", "progression": "Progression fantasy", "cultivation": "Cultivation", "dungeon": "Dungeons",
    "isekai": "Isekai", "tower-climbing": "Tower climbing", "system-apocalypse": "System apocalypse",
    "base-building": "Base building", "time-loop": "Time loop", "academy": "Academy", "crafting": "Crafting",
    "monster-mc": "Monster MC", "wuxia": "Wuxia",
}
#: Mechanic tag, label, and the taste dimension it belongs to, in the order that decides ties.
MECHANICS = (
    ("system-apocalypse", "System apocalypse", None), ("isekai", "Isekai", None), ("dungeon", "Dungeons", None), ("cultivation", "Cultivation", None),
    ("crafting", "Crafting", "crafting"), ("base-building", "Base building", "crafting"), ("time-loop", "Time loop", None), ("academy", "Academy", None),
    ("monster-mc", "Monster protagonist", None), ("stats", "Game stats", "stats"), ("solo-protagonist", "Solo adventures", "teamwork"),
    ("team-adventure", "Team adventures", "teamwork"), ("comedy", "Comedy", "humor"), ("politics", "Political intrigue", "politics"),
    ("survival", "Survival", None), ("exploration", "Exploration", "worldbuilding"), ("cozy", "Cozy everyday life", "cozy"),
)
SEVERITY = {"present": 0, "unknown": 1, "stale": 2, "missing": 3}
CHECK_GROUPS = {
    "audio": ("audio-verified",), "date": ("audio-date",), "cover": ("cover-url", "cover-asset", "cover-observation"),
    "metadata": ("source-description", "original-summary", "extracted-metadata", "reviewed-metadata", "model-assessment"),
    "readers": ("reader-sample", "reader-adequacy", "reader-traits", "reader-observation"), "freshness": ("source-freshness",),
}
SERIES_METADATA = ("series-summary", "series-extracted-metadata", "series-reviewed-metadata")
PUBLIC_NAMES = ("catalog.json", "series.json", "review.json", "meta.json", "health.json")
