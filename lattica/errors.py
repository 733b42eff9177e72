"""Errors of the engine. A request that can't be resolved fails; no predicate is ever dropped."""


class RequestError(ValueError):
    """A request names something unknown, ambiguous or invalid."""


class ContractError(RuntimeError):
    """A table lacks columns that the catalog refers to."""


class Truncated(RuntimeError):
    """A result has more rows than its cap."""


class Unavailable(RuntimeError):
    """No store that could answer can be reached; that is not an empty answer."""
