"""Errors raised while a study is being defined."""


class StudyError(ValueError):
    """A definition that cannot be turned into a plan."""
