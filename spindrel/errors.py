"""Errors are raised, never turned into an empty result."""


class SpindrelError(Exception):
    """Any failure of this library."""


class ContractError(SpindrelError):
    """A row breaks its contract."""


class DataIntegrityError(SpindrelError):
    """A source is missing, incomplete or inconsistent."""


class CompositionError(SpindrelError):
    """A text can't be composed."""


class EncodingError(SpindrelError):
    """An encoder gives vectors of a wrong shape or norm."""


class StoreError(SpindrelError):
    """A vector collection is unusable or misused."""


class EmptyCollectionError(StoreError):
    """A search in a collection without rows."""


class MetricError(SpindrelError):
    """A ranking or judgment can't be evaluated."""


class DuplicateError(SpindrelError):
    """Duplicate detection lacks what it needs."""


class EventError(SpindrelError):
    """A change log is out of order or incomplete."""


class ArtifactError(SpindrelError):
    """An artifact breaks its contract."""


class ConfigurationError(SpindrelError):
    """A setting is missing or out of range."""
