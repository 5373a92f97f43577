"""The registered queries: each one runs a part of the engine over the driver's tables, beside its SQL."""

from .page_queries import QUERIES as _PAGES
from .record_queries import QUERIES as _RECORDS
from .run_queries import QUERIES as _RUNS
from .stream_queries import QUERIES as _STREAMS
from .value_queries import QUERIES as _VALUES

ALL = {**_RECORDS, **_RUNS, **_VALUES, **_PAGES, **_STREAMS}
