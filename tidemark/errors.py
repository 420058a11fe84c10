"""Errors that callers may want to catch."""


class EntityNotFoundError(RuntimeError):
    """A single lookup found no row for the entity."""

    def __init__(self, entity_id: str) -> None:
        super().__init__(f"no current row for entity {entity_id!r}")
        self.entity_id = entity_id


class SchemaMismatchError(RuntimeError):
    """A stored table was written under another schema."""


class TableNotFoundError(RuntimeError):
    """A current-value table has no published version."""


class CapacityExceededError(RuntimeError):
    """More entities than the table may hold."""


class WriteSyncTimeoutError(TimeoutError):
    """A written row was not applied in time; it stays queued."""

    def __init__(self, msg_id: str, timeout_ms: int) -> None:
        super().__init__(f"message {msg_id} not applied within {timeout_ms} ms")
        self.msg_id = msg_id
        self.timeout_ms = timeout_ms


class ConflictError(RuntimeError):
    """Another writer committed first; what was done has no effect and may be repeated."""


class LockHeldError(RuntimeError):
    """Another process holds the table's lock."""


class HydrationError(RuntimeError):
    """Base of hydration failures."""


class HydrationConflictError(HydrationError):
    """A current version or a live consumer is in the way."""


class EmptyDatasetError(HydrationError):
    """There is nothing to hydrate from."""


class UpgradeError(RuntimeError):
    """Base of schema-upgrade failures."""


class UpgradeConflictError(UpgradeError):
    """Lock held, log not drained, or no current version."""


class UpgradeIncompatibleError(UpgradeError):
    """The new schema breaks a compatibility rule."""


class UpgradeAbortedError(UpgradeError):
    """Another writer moved the pointer first."""
