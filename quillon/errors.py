"""What can be wrong with a statement."""


class EngineProblem(Exception):
    """Any problem that the engine itself reports."""


class SyntaxProblem(EngineProblem):
    """The text isn't a statement of the dialect."""


class NameProblem(EngineProblem):
    """A name is unknown, ambiguous or already taken."""


class UnknownColumn(NameProblem):
    """No source of the query has the column."""


class TypeProblem(EngineProblem):
    """Types don't fit."""


class ConstraintProblem(EngineProblem):
    """Rows would violate a constraint; the table stays as it was."""
