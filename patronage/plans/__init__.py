"""Reports that put the metrics together: single analyses, the full suite, the predictor."""

from .predictor import LifetimeValuePredictor
from .reports import BasicInfo, Cohort, Growth, NewExisting, Retention, RFMSegmentation
from .suite import FullAnalysis

__all__ = [
    "BasicInfo",
    "Cohort",
    "FullAnalysis",
    "Growth",
    "LifetimeValuePredictor",
    "NewExisting",
    "RFMSegmentation",
    "Retention",
]
