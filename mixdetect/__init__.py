"""mixdetect: density-based anomaly detection for tables mixing categorical
and continuous columns, built on Spark DataFrames."""

from .spec import DetectorParams, GmmParams, LogisticParams, MixedSpec, SlotLayout, infer_spec
from .plans.detector import Detector, DetectorModel
from .plans.estimators import ConditionalLogistic, ConditionalModel, Mixture, MixtureModel

__all__ = ["ConditionalLogistic", "ConditionalModel", "Detector", "DetectorModel", "DetectorParams", "GmmParams",
           "LogisticParams", "MixedSpec", "Mixture", "MixtureModel", "SlotLayout", "infer_spec"]
