from panelsignal.functions.columns import (  # noqa: F401
    finite_or_null,
    log1p_or_null,
    percent_to_fraction,
    round_doubles,
    safe_div,
    sum_skip_nulls,
)
