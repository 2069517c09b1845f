from larkspur.functions.expr import (  # noqa: F401
    comparable,
    is_missing,
    js_number,
    js_string,
    numeric_field,
    parse_float,
    quoted,
    safe_divisor,
)
