"""Customer-panel analytics on Spark DataFrames.

A *panel* has one row per (entity, period); which catalogue items the entity
holds in that period travels in one BIGINT, bit ``i`` standing for item ``i``.
"""

from panelspark.spec import PanelSpec

__all__ = ["PanelSpec"]

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so that workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
