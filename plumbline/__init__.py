"""Plumbline: table quality measured, scored and repaired with Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from plumbline.plans.assess import Assessment, assess
from plumbline.plans.report import quality_report
from plumbline.session import build_session

# Functions sent to tasks travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["Assessment", "assess", "build_session", "quality_report"]
