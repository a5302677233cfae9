"""Errors of the engine."""


class QualityError(ValueError):
    """Base of the errors below; ``kind`` names the sort of failure in reports."""

    kind = "error"


class InvalidFrame(QualityError):
    kind = "invalid_frame"


class IncompatibleFrames(QualityError):
    kind = "incompatible_frames"


class UnsupportedInput(QualityError):
    kind = "unsupported_input"


class UnknownMetric(QualityError):
    kind = "unknown_metric"


class BundleError(QualityError):
    kind = "bundle"
