"""One request over any mix of members, routed to the operator that computes it.

Members are measure names (``lives``, ``record_count``, ...), share names
(``pct_ecosystem_lives``, ...) or denominator names (``ecosystem_total_lives``,
...). A request with no share or denominator is additive: it is answered from
a stored rollup when one is given and covers it, else from the fact (joining
the hierarchy only for a hierarchy column). Otherwise the shares operator
computes the additive measures, the shares and the named denominators in one
plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame

from ..functions.members import MEASURE_NAMES, all_of, default_filter
from .rollup import lives_from_rollup
from .shares import DENOMINATORS, SHARES, lives_shares
from .summary import lives_summary


def lives_request(
    df: DataFrame,
    members: Sequence[str],
    dimensions: Sequence[str] = (),
    where: Column | None = None,
    segments: Iterable[str] = (),
    defaults: bool = False,
    hierarchy: DataFrame | None = None,
    rollup_path: str | None = None,
    method: str = "join",
    strict: bool = False,
    targets: dict[str, float] | None = None,
    hierarchy_match: str = "both",
    check_hierarchy: bool = True,
    max_age: dt.timedelta | None = None,
) -> DataFrame:
    """The members by the dimensions; see ``lives_summary`` and ``lives_shares`` for the options.

    ``rollup_path`` and ``max_age`` let a stored rollup built within that time
    answer what it covers; a hierarchy that the request does not use is no
    obstacle to that.
    """
    members = list(members)
    unknown = [m for m in members if m not in MEASURE_NAMES and m not in SHARES and m not in DENOMINATORS]
    if unknown:
        raise KeyError(f"unknown members {unknown}")
    measures = [m for m in members if m in MEASURE_NAMES]
    shares = [m for m in members if m in SHARES]
    denominators = [m for m in members if m in DENOMINATORS]
    segments = list(segments)
    if not shares and not denominators:
        if rollup_path is not None:
            # The default filters read stored dimensions only, so they travel as a condition.
            cond = all_of([where, default_filter() if defaults else None])
            return lives_from_rollup(df.sparkSession, rollup_path, df, measures, dimensions, cond, segments, max_age=max_age,
                                     hierarchy=hierarchy, hierarchy_match=hierarchy_match, check_hierarchy=check_hierarchy)
        return lives_summary(df, measures, dimensions, where, segments, defaults, hierarchy, hierarchy_match, check_hierarchy)
    # A denominator asked alone is computed through the share that uses it.
    users = {den: s for s, den in SHARES.items()}
    wanted = list(dict.fromkeys([*shares, *[users[d] for d in denominators]]))
    out = lives_shares(df, wanted, dimensions, where, segments, defaults, measures or ["lives"],
                       include_hidden=bool(denominators), strict=strict, method=method, targets=targets,
                       hierarchy=hierarchy, hierarchy_match=hierarchy_match, check_hierarchy=check_hierarchy)
    keep = [*dimensions, *(measures or []), *denominators, *shares]
    if targets:
        keep += [f"meets_{s}" for s in shares if s in targets]
    return out.select(*keep)
