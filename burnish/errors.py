"""What can go wrong before any row is read."""

from __future__ import annotations

from collections.abc import Iterable


class ContractError(Exception):
    """Base of all errors raised here."""


class _Findings(ContractError):
    """Ordered findings; one finding is the message itself, several are listed."""

    headline = "findings"

    def __init__(self, errors: Iterable[str] | str):
        self.errors: tuple[str, ...] = (errors,) if isinstance(errors, str) else tuple(errors)
        super().__init__(self.errors[0] if len(self.errors) == 1 else f"{len(self.errors)} {self.headline}:\n" + "\n".join(f"- {e}" for e in self.errors))

    def __reduce__(self):
        return type(self), (self.errors,)


class CompilationError(_Findings):
    """An authored contract that does not compile."""

    headline = "contract findings"


class SchemaValidationError(_Findings):
    """A DataFrame that a contract cannot be bound to."""

    headline = "schema findings"


class SchemaWarning(UserWarning):
    """A recoverable finding, such as an allowed missing source."""
