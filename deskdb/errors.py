"""What the engine raises."""


class DeskError(Exception):
    """Any error of the engine."""


class ParseError(DeskError):
    """A statement that is not of the dialect."""


class AnalysisError(DeskError):
    """A statement that names what isn't there, or compares what can't be compared."""


class NotConnected(DeskError):
    """A statement that needs a database, without one."""
