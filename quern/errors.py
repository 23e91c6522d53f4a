"""What the facade raises. DataFrame functions return empty frames instead."""


class QuernError(Exception):
    status = 500


class InvalidArgument(QuernError):
    """A required parameter is missing or blank, or has no sense."""

    status = 400


class NotFound(QuernError):
    status = 404


class DatasetUnavailable(QuernError):
    """No dataset is open, or its tables can't be read."""

    status = 500


class NotReady(QuernError):
    status = 503
