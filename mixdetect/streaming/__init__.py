from .quality import QualityListener, score_stream_observed
from .scoring import score_stream, score_stream_to_parquet, start_anomaly_sink, start_scoring_query
