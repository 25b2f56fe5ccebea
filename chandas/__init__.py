"""chandas: verse analytics and corpus processing as Spark DataFrame operators."""

from pyspark import cloudpickle as _cloudpickle


def _ship_by_value() -> None:
    """Functions handed to executors travel with the job, so the package need not be installed there."""
    import sys

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
