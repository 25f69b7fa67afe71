"""Errors that callers may want to tell apart."""


class FrameError(Exception):
    """Base of this library's errors."""


class DifferingInputs(FrameError):
    """The two inputs differ in size, planes or sample type."""


class UnsupportedInput(FrameError):
    """An input has a layout or sample type that no operator takes."""


class SamplingError(FrameError):
    """Frame indices do not exist, or two lists do not match."""


class ConfigurationError(FrameError):
    """A display, colour space or parameter is missing or malformed."""
