"""Errors and warnings of the engine."""


class BadInput(ValueError):
    """A request that the data or the parameters do not allow."""


class NeedsDirected(BadInput):
    """The measure is defined for directed networks only."""


class NoSessions(BadInput):
    """Separate sessions were asked for and the network has none."""


class UnknownMeasure(BadInput):
    """No measure has that name."""


class BudgetExceeded(BadInput):
    """A search that counts routes one by one went beyond its limit."""


class UndefinedResult(UserWarning):
    """A quantity is not determined by the data and is reported as missing."""


class BadScope(BadInput):
    """A null model is not defined within the scope asked for."""


class NoValidDraw(BadInput):
    """No surrogate kept what was asked for within the tries allowed."""
