"""Exceptions that callers may want to tell apart."""


class PlumblineError(Exception):
    """Anything this library raises on purpose."""


class ConfigError(PlumblineError):
    """A setting is unknown, of the wrong type or out of range."""


class DatasetError(PlumblineError):
    """A folder isn't a dataset that can be read."""


class SecurityError(PlumblineError):
    """A path or an archive reaches outside its place or is too large."""


class NotFound(PlumblineError):
    """No such audit, image or finding."""


class Cancelled(PlumblineError):
    """The audit was cancelled."""
