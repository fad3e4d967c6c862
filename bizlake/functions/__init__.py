"""Column expressions: every function takes columns and returns a column."""

from .amounts import (  # noqa: F401
    checked_float, checked_int, decimal_comma, double_with_comma, parse_amount,
)
from .dates import (  # noqa: F401
    age_years, date_or_null, day_first_date, repair_shifted_year, strict_date, year_text,
)
from .identifiers import (  # noqa: F401
    normalise_identifier, site_key, site_number, strip_country_prefix,
)
from .text import (  # noqa: F401
    contains_ignoring_case, label_or, null_when_token, programme_label, scrub, strip,
    topic_level_1, topic_level_2, trim_or_empty,
)
