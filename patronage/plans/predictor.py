"""Train, select and apply a classifier of lifetime-value clusters."""

from __future__ import annotations

import warnings
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..operators import ltv
from ..operators.materialize import materialize, release
from ..operators.models import DEFAULT_GRIDS, MODERN, Score, Shape, search
from ..operators.rfm import REVENUE
from .reports import RFMSegmentation


class LifetimeValuePredictor:
    """Predict the revenue cluster of a customer from its RFM segment.

    Monetary value is revenue over months, so the label is close to a function
    of a feature: a high accuracy here shows that, not skill on new data.
    """

    def __init__(self, segmentation: RFMSegmentation, include_customer_id: bool = False):
        self.segmentation = segmentation
        self.include_customer_id = include_customer_id
        self.scores: list[Score] | None = None
        self.best: Score | None = None
        self.preprocessor: PipelineModel | None = None
        self.pipeline: PipelineModel | None = None
        self.ltv_cluster_info: DataFrame | None = None
        self._labelled: DataFrame | None = None

    @cached_property
    def frame(self) -> DataFrame:
        """Revenue, RFM segment and customer segment, one row per pair of customer and segment."""
        seg = self.segmentation
        return materialize(ltv.feature_frame(seg.segmented, seg.measures))

    def cluster_hint(self, most: int = 9) -> DataFrame:
        return ltv.cluster_hint(self.frame, most)

    def choose_best_predictor(
        self,
        revenue_clusters: int = 3,
        remove_outlier_quantile: float = 1,
        cv: int = 5,
        only_modern_model: bool = True,
        grids: dict[str, list[dict]] | None = None,
        parallelism: int = 4,
        seed: int = 1,
    ) -> list[Score]:
        """Search the grids by cross-validated accuracy and keep the best classifier.

        Every call starts from the untrimmed customers.  ``grids`` replaces the
        default grids, whose families are limited by ``only_modern_model``.
        The whole grid is always searched: a random search of ten draws would
        cover each of these grids as well.
        """
        if grids is None:
            names = MODERN if only_modern_model else tuple(DEFAULT_GRIDS)
            grids = {name: DEFAULT_GRIDS[name] for name in names}
        data, shape = self.training_data(revenue_clusters, remove_outlier_quantile, cv, seed)
        self.scores = search(data, grids, shape, cv, parallelism)
        release(data)
        self.best = max(self.scores, key=lambda s: s.best_score)
        self.pipeline = PipelineModel(stages=[self.preprocessor, self.best.best_estimator])
        return self.scores

    def training_data(
        self, revenue_clusters: int = 3, remove_outlier_quantile: float = 1, cv: int = 5, seed: int = 1
    ) -> tuple[DataFrame, Shape]:
        """Trim, label, encode and deal out the customers.

        The frame has customer, customer_segment, features, label and fold.
        Preprocessing is fitted once, on all of it, before any fold is held out.
        """
        kept = ltv.trim_outliers(self.frame, remove_outlier_quantile)
        release(self._labelled)
        self._labelled = labelled = materialize(ltv.with_ltv_cluster(kept, revenue_clusters))
        self.ltv_cluster_info = ltv.ltv_cluster_info(labelled)
        numeric, categorical = ltv.feature_columns(labelled, self.include_customer_id)
        if ltv.missing_values(labelled, numeric + categorical):
            warnings.warn(
                "missing feature values: numbers are filled with the mean, text with the commonest value",
                stacklevel=3,
            )
        self.preprocessor = ltv.preprocessor(labelled, numeric, categorical)
        folded = ltv.with_folds(self.preprocessor.transform(labelled), cv)
        label = F.col(ltv.LABEL).cast("double").alias("label")
        data = materialize(folded.select("customer", "customer_segment", "features", label, "fold"))
        rows, classes = data.agg(F.count("*"), F.max("label")).first()
        features = len(data.first()["features"])
        return data, Shape(rows, features, int(classes) + 1, seed)

    @property
    def predictor_scores(self) -> DataFrame:
        """Family, score and parameters; the fitted models stay in ``scores``."""
        self._need_fit()
        rows = [(s.model, float(s.best_score), str(s.best_params)) for s in self.scores]
        return self.segmentation.base.spark.createDataFrame(
            rows, "model string, best_score double, best_params string"
        )

    @property
    def best_estimator(self):
        self._need_fit()
        return self.best.best_estimator

    def run_best_predictor(self, segmentation: RFMSegmentation) -> DataFrame:
        """Predicted cluster of every customer of another segmentation."""
        self._need_fit()
        frame = ltv.feature_frame(segmentation.segmented.drop(REVENUE), segmentation.measures)
        scored = self.pipeline.transform(frame)
        return scored.select("customer", F.col("prediction").cast("int").alias(ltv.PREDICTED))

    def close(self) -> None:
        """Free the frames this predictor holds; ``frame`` is computed anew if asked for."""
        release(self._labelled, self.__dict__.pop("frame", None))
        self._labelled = self.ltv_cluster_info = None

    def __enter__(self) -> "LifetimeValuePredictor":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def _need_fit(self):
        if self.scores is None:
            raise RuntimeError("run choose_best_predictor first")
