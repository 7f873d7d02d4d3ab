"""Predictive-maintenance analytics for fleet sensor data, expressed as Spark plans."""

from .params import StudyParams
from .plans.study import Study

__all__ = ["Study", "StudyParams"]
