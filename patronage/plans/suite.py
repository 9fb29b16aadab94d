"""All reports over one base."""

from __future__ import annotations

from ..operators.materialize import checkpoint_dir_ready
from ..sources import Base
from .predictor import LifetimeValuePredictor
from .reports import BasicInfo, Cohort, Growth, NewExisting, Retention, RFMSegmentation


class FullAnalysis:
    """Every report plus the predictor, sharing one activity frame.

    The source is read and shuffled once, to customer, segment and month.  The
    frame is a bucketed table if ``stored``, which is the default where the
    session names a checkpoint folder, as on a cluster; else it is cached.
    Call :meth:`close`, or use it as a context manager, to free it.
    """

    def __init__(self, base: Base, stored: bool | None = None):
        stored = checkpoint_dir_ready(base.spark) if stored is None else stored
        self.base = base.require_dates().store() if stored else base.require_dates().cache()
        self.reports = {
            "Basic Info": BasicInfo(base),
            "Growth": Growth(base),
            "New Existing Customer": NewExisting(base),
            "Retention": Retention(base),
            "Cohort": Cohort(base),
            "Segmentation": RFMSegmentation(base),
        }
        self.predictor = LifetimeValuePredictor(self.reports["Segmentation"])

    def full_result(self) -> dict:
        return dict(self.reports)

    def analysis_data(self) -> dict:
        return {f"{name} data": report.data for name, report in self.reports.items()}

    def chart_data(self) -> dict:
        """Frames to draw; drawing is left to the caller."""
        return {f"{name} chart": report.charts for name, report in self.reports.items()}

    def close(self) -> None:
        self.base.unpersist()

    def __enter__(self) -> "FullAnalysis":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
