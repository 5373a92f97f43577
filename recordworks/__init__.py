"""recordworks: listing-data jobs on Spark DataFrames."""

from .session import local_session, tuned  # noqa: F401
from .templates import Template, template  # noqa: F401
