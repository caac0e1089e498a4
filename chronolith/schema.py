"""Record schemas, options and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()

#: One JSON object per line; `type` tells commit, commit_file, commit_parent and dev records apart.
RECORD = T.StructType(
    [T.StructField("type", _S), T.StructField("sha", _S), T.StructField("tree", _S), T.StructField("parents", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "message")]
    + [T.StructField(n, _L) for n in ("additions", "deletions", "files_changed")]
    + [T.StructField(n, _S) for n in ("commit", "path_current", "path_previous", "status", "old_hash", "new_hash")]
    + [T.StructField(n, _L) for n in ("old_size", "new_size")]
    + [T.StructField(n, _S) for n in ("parent_sha", "dev_id", "name", "email")]
)
#: Where a line that is no JSON object goes, so that it can be reported.
CORRUPT = "_corrupt_record"

#: Thresholds of the statistics.
COLD_RATIO = 0.5
ACTIVE_BUS_FACTOR = 3
OLD_AGE_DAYS = 180
DECLINING_TREND = 0.5
TREND_MONTHS = 3
MIN_SAMPLE = 8
DECLINING_FLOOR = 0.01
REFACTOR_RATIO = 0.8
BALANCED_RATIO = 0.4
MECHANICAL_FILES = 10
MECHANICAL_LINES = 5.0
SPECIALIST_BANDS = ((0.15, "broad generalist"), (0.35, "balanced"), (0.7, "focused specialist"))
NARROW_SPECIALIST = "narrow specialist"
OWNERSHIP = 0.8
EXTREME_PCT, MODERATE_PCT = 10.0, 25.0
SUSPECT_FLOOR = 0.10
TREE_DEPTH, TREE_CHILDREN = 3, 50
RISK_LABELS = ("fading-silo", "silo", "active-core", "active", "cold")
MESSAGE_BYTES, MESSAGE_CUT = 80, 77


@dataclass(frozen=True)
class Options:
    """How a history is loaded. Dates are inclusive YYYY-MM-DD; a half-life of 0 or less means the default."""

    since: str | None = None
    until: str | None = None
    half_life_days: int = 90
    coupling_max_files: int = 50
    anchor: str = "global"  # or "stream": decay counts from the latest date seen so far

    @property
    def half_life(self) -> int:
        return self.half_life_days if self.half_life_days > 0 else 90


@dataclass(frozen=True)
class Limits:
    """Thresholds of pair statistics."""

    coupling_min_changes: int = 5
    network_min_files: int = 5
