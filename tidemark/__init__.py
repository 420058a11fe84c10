"""tidemark: a Spark-native feature store and data-preparation engine."""

from tidemark.errors import (
    EmptyDatasetError,
    EntityNotFoundError,
    HydrationConflictError,
    HydrationError,
    SchemaMismatchError,
    TableNotFoundError,
    UpgradeAbortedError,
    UpgradeConflictError,
    UpgradeError,
    UpgradeIncompatibleError,
    WriteSyncTimeoutError,
)
from tidemark.schema import DType, FeatureField, FeatureSchema

__version__ = "0.1.0"

__all__ = [
    "DType",
    "EmptyDatasetError",
    "EntityNotFoundError",
    "FeatureField",
    "FeatureSchema",
    "HydrationConflictError",
    "HydrationError",
    "SchemaMismatchError",
    "TableNotFoundError",
    "UpgradeAbortedError",
    "UpgradeConflictError",
    "UpgradeError",
    "UpgradeIncompatibleError",
    "WriteSyncTimeoutError",
    "__version__",
]
