"""Errors of the public API: seven codes and an envelope that callers can serialise."""

from __future__ import annotations

#: Codes that callers see: fixed values.
CODES = ("invalid_input", "not_found", "already_exists", "constraint_violation", "parse_error", "unavailable", "internal_error")
MAX_RESULT_COUNT = 50
MAX_RESPONSE_BYTES = 900_000


class DomainError(Exception):
    """An error with a code, a message and details that are fit to show."""

    def __init__(self, code: str, message: str, **details):
        if code not in CODES:
            code = "internal_error"
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, "details": self.details}}


def check_count(name: str, value: int, maximum: int = MAX_RESULT_COUNT) -> int:
    """A count from 1 to ``maximum``, or invalid_input."""
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= maximum:
        raise DomainError("invalid_input", f"{name} must be a whole number from 1 to {maximum}", value=value)
    return value


def guard(produce):
    """Call ``produce`` and give (result, None) or (None, envelope): domain errors as they are, others as internal_error."""
    import json

    try:
        result = produce()
        if len(json.dumps(result, default=str).encode()) > MAX_RESPONSE_BYTES:
            raise DomainError("constraint_violation", f"the response is larger than {MAX_RESPONSE_BYTES} bytes")
        return result, None
    except DomainError as e:
        return None, e.envelope()
    except Exception as e:  # the boundary of the API
        return None, DomainError("internal_error", f"{type(e).__name__}: {e}").envelope()
