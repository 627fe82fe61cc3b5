"""Errors. No message ever holds document text."""

from __future__ import annotations


class PalimpsestError(Exception):
    """Base of every error the library raises on purpose."""


class UnknownDetectorError(PalimpsestError, KeyError):
    def __init__(self, name: str, known: tuple[str, ...] = ()) -> None:
        self.name, self.known = name, known
        super().__init__(f"no detector named {name!r}" + (f" (there are: {', '.join(known)})" if known else ""))


class DuplicateDetectorError(PalimpsestError, KeyError):
    def __init__(self, name: str) -> None:
        self.name = name
        super().__init__(f"a detector named {name!r} exists; remove it or pass replace_existing=True")


class MissingDependencyError(PalimpsestError, ImportError):
    def __init__(self, detector: str, extra: str) -> None:
        self.detector, self.extra = detector, extra
        super().__init__(f"detector {detector!r} needs the optional dependency {extra!r}")


class DetectorError(PalimpsestError):
    """A detector failed; only the kind of failure is told."""

    def __init__(self, detector: str, cause: str) -> None:
        self.detector, self.cause = detector, cause
        super().__init__(f"detector {detector!r} failed: {cause}")

    def __reduce__(self) -> tuple:
        return type(self), (self.detector, self.cause)


class LimitExceededError(PalimpsestError, ValueError):
    def __init__(self, what: str, actual: int, limit: int) -> None:
        self.what, self.actual, self.limit = what, actual, limit
        super().__init__(f"{what}: {actual}, and the limit is {limit}")
