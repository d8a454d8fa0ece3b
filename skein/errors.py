"""Exceptions raised by the engine."""


class SkeinError(Exception):
    """Base of all errors of the engine."""


class DimensionMismatch(SkeinError, ValueError):
    def __init__(self, expected, actual):
        super().__init__(f"dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class VectorNotFound(SkeinError, KeyError):
    pass


class DuplicateVector(SkeinError, ValueError):
    pass


class InvalidVector(SkeinError, ValueError):
    pass


class DatabaseError(SkeinError, RuntimeError):
    pass
