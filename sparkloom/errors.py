"""Errors of this library; all are ``LoomError``."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors raised on purpose."""


class DuplicateStep(LoomError):
    """A step name is used twice."""


class MissingInput(LoomError):
    """A step needs a step that isn't there."""


class CyclicGraph(LoomError):
    """Steps need each other in a circle; ``path`` names them in order."""

    def __init__(self, path: list[str]) -> None:
        self.path = path
        super().__init__("steps need each other: " + " -> ".join(path))


class BindingError(LoomError):
    """A parameter of a step's function can't be given a value."""


class StepFailed(LoomError):
    """A step failed for good; ``report`` has what ran before it, the cause is chained."""

    def __init__(self, step: str, attempts: int, report: object) -> None:
        self.step, self.attempts, self.report = step, attempts, report
        super().__init__(f"step {step!r} failed after {attempts} attempt(s)")


class StepTimeout(LoomError):
    """A step's Spark jobs were cancelled at its deadline."""


class NoSharedFolder(LoomError):
    """The cluster names no folder that driver and executors share."""


class StateError(LoomError):
    """Stored state can't be read."""
