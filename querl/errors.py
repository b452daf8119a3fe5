"""The one error that statements raise."""


class EngineError(Exception):
    """A statement can't be carried out; the message says why."""
