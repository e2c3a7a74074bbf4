"""A Spark-native engine for finding and removing duplicate text in large corpora."""

from quern.config import PipelineConfig
from quern.errors import CheckpointError, ConfigError, DedupError, EvaluationError, HashingError, IOError, StorageError
from quern.operators.minhash import MinHasher
from quern.plans.pipeline import DedupPipeline
from quern.sources.readers import Document

__version__ = "0.1.0"
__all__ = ["CheckpointError", "ConfigError", "DedupError", "DedupPipeline", "Document", "EvaluationError", "HashingError", "IOError", "MinHasher", "PipelineConfig", "StorageError", "__version__"]
