from tessera.functions.scalars import (age_days, flag, full_name, parse_utc, r6,  # noqa: F401
                                       safe_div, to_double, to_int_or_zero)
