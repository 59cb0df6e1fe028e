"""What operations raise; success returns."""


class StoreError(Exception):
    """Base of all errors here."""


class NotFoundError(StoreError, KeyError):
    """No live object, row, or key in a row."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class InvalidArgumentError(StoreError, ValueError):
    """A bad option or input, a write in the read-only phase, a full row index."""


class StoreIoError(StoreError, OSError):
    """The file system refused."""


class CorruptionError(StoreError):
    """Committed data is missing or malformed."""


class NotOpenError(StoreError):
    """A data operation before open or after close."""
