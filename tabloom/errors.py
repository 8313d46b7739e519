"""Errors raised by the library."""


class PrepareError(ValueError):
    """A preparation step was asked to do something its input does not allow."""

    def __init__(self, step: str, op: str | None, message: str):
        self.step = step
        self.op = op
        self.message = message
        super().__init__(f"[{step}{'/' + op if op else ''}] {message}")


class SourceError(ValueError):
    """A dataset cannot be read or written as asked."""


class QueryError(ValueError):
    """A SQL text was refused by the guarded runner."""


class TrainError(ValueError):
    """A model cannot be fitted, tuned or applied as asked."""
