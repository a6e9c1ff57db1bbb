"""Imports every module that registers queries."""

from . import profile  # noqa: F401
from . import buckets  # noqa: F401
from . import series  # noqa: F401
from . import vectors  # noqa: F401
from . import records  # noqa: F401
from . import state  # noqa: F401
from . import costs  # noqa: F401
from . import streams  # noqa: F401
