"""What goes wrong, by kind."""


class FactloomError(Exception):
    """Base of all errors raised on purpose."""


class Unsupported(FactloomError):
    """A construct that is understood but not offered."""


class InvalidQuery(FactloomError):
    """Text or a plan that has no meaning."""


class LimitExceeded(FactloomError):
    """A search or cascade grew beyond its guard; results are never cut short instead."""


class ConstraintViolated(FactloomError):
    """A write that uniqueness, types or rules forbid."""


class UnsafeRule(InvalidQuery):
    """A rule with variables that no positive atom binds."""


class Unstratified(InvalidQuery):
    """Negation or aggregation through recursion."""
