"""covlens: coverage ("lives") analytics as Spark DataFrame functions."""

from .functions.members import (
    DIMENSION_NAMES,
    MEASURE_NAMES,
    SEGMENT_NAMES,
    dimension,
    filter_group,
    measure,
    segment,
)
from .operators.hierarchy import check_many_to_one, drill, parent_totals, with_hierarchy
from .operators.quality import check_lives, hash_check, key_check
from .operators.request import lives_request
from .operators.rollup import build_rollup, lives_from_rollup, read_rollup, refresh_rollup
from .operators.trends import trend
from .operators.shares import lives_shares
from .operators.summary import config_count, lives_summary
from .sources.readers import read_benefit_config, read_hierarchy, read_lives

__all__ = [
    "build_rollup",
    "check_lives",
    "check_many_to_one",
    "drill",
    "hash_check",
    "key_check",
    "lives_from_rollup",
    "parent_totals",
    "read_rollup",
    "refresh_rollup",
    "trend",
    "with_hierarchy",
    "DIMENSION_NAMES",
    "MEASURE_NAMES",
    "SEGMENT_NAMES",
    "config_count",
    "dimension",
    "filter_group",
    "lives_request",
    "lives_shares",
    "lives_summary",
    "measure",
    "read_benefit_config",
    "read_hierarchy",
    "read_lives",
    "segment",
]
