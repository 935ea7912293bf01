"""Error classes with the exit codes of the command line."""


class SedimentaError(Exception):
    exit_code = 1


class UserError(SedimentaError):
    """Wrong arguments or configuration."""

    exit_code = 1


class ParseError(SedimentaError):
    """An input that can't be parsed."""

    exit_code = 2


class ProviderError(SedimentaError):
    """A failed call of an embedding or planning provider."""

    exit_code = 3

    def __init__(self, message: str, retryable: bool = False, status: int | None = None):
        super().__init__(message)
        self.retryable, self.status = retryable, status


class CollectionError(SedimentaError):
    """A failed write to a vector collection."""

    exit_code = 4


class IntegrityError(SedimentaError):
    """Stored state contradicts the request."""

    exit_code = 5


class Interrupted(SedimentaError):
    """A run that was stopped on request; it can be taken up."""

    exit_code = 130
