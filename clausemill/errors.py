"""Errors of the public surface."""


class SegmentationError(Exception):
    """Any error of this package."""


class InvalidLanguageError(SegmentationError):
    """A language code that no bundled rules answer to."""


class ProcessingError(SegmentationError):
    """A text that cannot be read or cut."""


class ConfigurationError(SegmentationError):
    """Rules or options that cannot work."""


class InvalidInputError(ProcessingError):
    """An input that cannot be decoded, such as bytes that its encoding does not have."""


class UnsupportedError(SegmentationError):
    """Something that this package does not offer."""
