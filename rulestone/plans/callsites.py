"""Building many Columns quickly: PySpark asks the JVM for each one where in the user's code it came from."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import ParamSpec, TypeVar

from pyspark.errors import utils

Arguments, Result = ParamSpec("Arguments"), TypeVar("Result")
_SWITCH = "_enable_debugging_cache"


def without_call_sites(build: Callable[Arguments, Result]) -> Callable[Arguments, Result]:
    """build with call sites switched off meanwhile, as by spark.python.sql.dataFrameDebugging.enabled; they would all name
    the compiler. Where PySpark has no such switch nothing changes."""

    @wraps(build)
    def quick(*args: Arguments.args, **kwargs: Arguments.kwargs) -> Result:
        if not hasattr(utils, _SWITCH):
            return build(*args, **kwargs)
        before = getattr(utils, _SWITCH)
        setattr(utils, _SWITCH, False)
        try:
            return build(*args, **kwargs)
        finally:
            setattr(utils, _SWITCH, before)

    return quick
