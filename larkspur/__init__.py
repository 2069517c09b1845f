"""A dataframe analytics engine declared in Spark's DataFrame API."""

from larkspur.operators.frame import Frame  # noqa: F401
from larkspur.session import get_session  # noqa: F401
