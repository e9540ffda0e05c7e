"""Column-expression helpers (JVM-side Catalyst expressions, no Python UDFs)."""

from shelfcast.functions.histogram import bin_edge, bin_index, outer_edges
from shelfcast.functions.numeric import (
    NULL_TOKENS,
    guarded_double,
    is_finite,
    null_tokens_to_null,
    round_half_even_to_step,
    truncate_to_long,
)
from shelfcast.functions.temporal import (
    DEFAULT_MONTH_FLAGS,
    compose_timestamp,
    in_last_week_of_month,
    month_flags,
    month_start,
    parse_date,
    parse_time_of_day,
    week_ending_sunday,
)

__all__ = [
    "NULL_TOKENS",
    "DEFAULT_MONTH_FLAGS",
    "bin_edge",
    "bin_index",
    "outer_edges",
    "guarded_double",
    "is_finite",
    "null_tokens_to_null",
    "round_half_even_to_step",
    "truncate_to_long",
    "compose_timestamp",
    "in_last_week_of_month",
    "month_flags",
    "month_start",
    "parse_date",
    "parse_time_of_day",
    "week_ending_sunday",
]
