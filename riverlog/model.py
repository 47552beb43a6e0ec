"""The entry model: column names, rule types and their checks.

An *entry* is one log record.  Four attributes have columns of their own
(``timestamp``, ``level``, ``message``, ``source``); every other JSON key lives
in ``fields``, a map of VARIANT values, so that "42" and 42 stay different and
rows of one table may hold different keys.  ``raw`` is the line as read.
Columns beyond these (file name, byte position, ids) pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

FIELDS = "fields"
RAW = "raw"
TEXT_ATTRIBUTES = ("level", "message", "source")
ATTRIBUTES = ("timestamp", *TEXT_ATTRIBUTES)

ENTRY_SCHEMA = (
    "timestamp timestamp, level string, message string, source string, "
    "fields map<string, variant>, raw string"
)

# The JSON keys that feed an attribute, strongest first.
TIMESTAMP_KEYS = ("timestamp", "time", "ts")
LEVEL_KEYS = ("level", "severity")
MESSAGE_KEYS = ("message", "msg")

# Severities in rising order.
LEVELS = ("debug", "info", "warn", "error", "fatal")

# Fixed value: mask used when a redaction names none.
DEFAULT_MASK = "[REDACTED]"

# Fixed value: JSON types a contract can ask for.
FIELD_TYPES = ("string", "number", "boolean")

# Fixed value: entries kept by a buffer that states no capacity.
DEFAULT_CAPACITY = 512


class RuleError(ValueError):
    """A rule or option that can never be applied."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise RuleError(message)


def require_rules(what: str, rules: Sequence | Mapping) -> None:
    require(len(rules) > 0, f"{what}: at least one rule is required")


@dataclass(frozen=True)
class MatchRule:
    """Keep entries whose ``field`` equals one of ``values`` (case ignored)."""

    field: str
    values: tuple[str, ...]

    def __init__(self, field: str, values: Iterable[str]):
        object.__setattr__(self, "field", field)
        object.__setattr__(self, "values", tuple(values))


@dataclass(frozen=True)
class FieldRule:
    """One line of a contract.  An empty ``type`` asks for presence only."""

    name: str
    required: bool = False
    type: str = ""


@dataclass(frozen=True)
class RedactRule:
    """Mask ``field`` always, or only when ``pattern`` is found in its text."""

    field: str
    pattern: str | None = None
    mask: str | None = None


@dataclass(frozen=True)
class RenameRule:
    source: str
    target: str


@dataclass(frozen=True)
class Route:
    """Send entries whose ``field`` equals one of ``values`` to ``name``."""

    field: str
    values: tuple[str, ...]
    name: str = field(default="")

    def __init__(self, field: str, values: Iterable[str], name: str):
        object.__setattr__(self, "field", field)
        object.__setattr__(self, "values", tuple(values))
        object.__setattr__(self, "name", name)


_UNSUPPORTED_REGEX = re.compile(
    r"""\(\?(?:=|!|<=|<!|>)     # look-around and atomic groups
      | (?:^|[^\\])(?:\\\\)*\\[1-9]   # back-references
      | [*+?}]\+                # possessive quantifiers
    """,
    re.VERBOSE,
)


def check_pattern(pattern: str) -> None:
    """Reject what a linear-time regex engine lacks, before Spark compiles it."""
    require(
        _UNSUPPORTED_REGEX.search(pattern) is None,
        f"pattern {pattern!r} uses look-around, back-references or possessive quantifiers",
    )
