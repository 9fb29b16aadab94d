"""Customer-marketing analytics on Spark DataFrames."""

from .plans import (
    BasicInfo,
    Cohort,
    FullAnalysis,
    Growth,
    LifetimeValuePredictor,
    NewExisting,
    Retention,
    RFMSegmentation,
)
from .sources import Base, Dates, Entity, Sale, SegmentTable, bind

__all__ = [
    "Base",
    "BasicInfo",
    "Cohort",
    "Dates",
    "Entity",
    "FullAnalysis",
    "Growth",
    "LifetimeValuePredictor",
    "NewExisting",
    "RFMSegmentation",
    "Retention",
    "Sale",
    "SegmentTable",
    "bind",
]
