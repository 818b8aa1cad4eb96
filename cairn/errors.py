"""What the engine raises while a plan is built."""


class PlanError(ValueError):
    """A plan that can't be built from what was given."""


class RuleError(PlanError):
    """Selection rules that don't fit the attributes."""


class UnsupportedError(PlanError, NotImplementedError):
    """A form of data or a test that the engine doesn't have."""


class ExistsError(PlanError):
    """A name that is taken already."""


class MissingError(PlanError, KeyError):
    """A name that nothing has."""

    __str__ = ValueError.__str__


class PortError(PlanError):
    """Ports that lack, or that don't fit each other."""


class KindError(PlanError):
    """A kind that the engine doesn't know."""
