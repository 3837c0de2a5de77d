"""Parameter studies on Spark: grids, sweeps, captures, collection and series."""

from .errors import StudyError
from .operators.axes import Axis, GradedAxis, UniformAxis
from .operators.capture import Capture
from .operators.grid import Space
from .operators.steps import Step, StepFailed
from .operators.sweep import sweep
from .plans.series import Mode, Plot, SeriesQuery
from .plans.study import Study

__all__ = [
    "Axis",
    "Capture",
    "GradedAxis",
    "Mode",
    "Plot",
    "SeriesQuery",
    "Space",
    "Step",
    "StepFailed",
    "Study",
    "StudyError",
    "UniformAxis",
    "sweep",
]
