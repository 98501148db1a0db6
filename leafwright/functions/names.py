"""Names of sheets, files, members, labels and batch items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwright.functions.text import is_blank, visible_words

# Fixed values.
DEFAULT_SHEET = r"^(?i)sheet\s*[0-9]+$"
FORBIDDEN_FILE = r'[\x00-\x1f\x7f\\<>:"|?*]'
DEVICE_NAME = r"^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
UNSAFE_LABEL = r"(?i)(?:[a-z][a-z0-9+.-]*://[^/\s]*@|(?:/Users/|/home/|[A-Za-z]:[\\/]))"
UNSAFE_LABEL_PATH = r"[=\s](?:/|[A-Za-z]:[\\/])"
ITEM_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
RESERVED_IDS = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]
MANIFEST_NAME = "manifest.json"
MAX_COMPONENT_BYTES = 255


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first failed check, or null."""
    whole = None
    for failed, reason in checks:
        whole = F.when(failed, reason) if whole is None else whole.when(failed, reason)
    return whole


def name_rule(name: Column) -> Column:
    """SHEET001 for a blank name, SHEET002 for a default one, else null."""
    return first_reason(
        (is_blank(name), "SHEET001"),
        (visible_words(name).rlike(DEFAULT_SHEET), "SHEET002"),
    )


def name_problem(name: Column) -> Column:
    """Why a text cannot name a sheet, or null."""
    return first_reason(
        (is_blank(name), "empty"),
        (name.rlike(r"[\[\]*?:/\\]"), "forbidden character"),
        (name.startswith("'") | name.endswith("'"), "edge apostrophe"),
    )


def unsafe_reason(name: Column) -> Column:
    """Why a name cannot be a file inside a bundle, or null; the first failure wins."""
    parts = F.split(name, "/")
    return first_reason(
        (name == "", "empty"),
        (name.rlike(FORBIDDEN_FILE), "forbidden character"),
        (name.startswith("/"), "absolute"),
        (F.exists(parts, lambda p: p.isin("", ".", "..")), "not normalised"),
        (F.lower(name) == MANIFEST_NAME, "reserved"),
        (
            F.exists(parts, lambda p: p.rlike(DEVICE_NAME) | p.endswith(".") | p.endswith(" ")),
            "not portable",
        ),
        (F.exists(parts, lambda p: F.octet_length(p) > MAX_COMPONENT_BYTES), "too long"),
    )


def unsafe_member(name: Column) -> Column:
    """A package member name that is absolute, drive-qualified or climbs out."""
    return (
        name.startswith("/")
        | name.startswith("\\")
        | name.rlike(r"^[A-Za-z]:")
        | F.exists(F.split(name, r"[/\\]"), lambda p: p == "..")
    )


def unquote(text: Column) -> Column:
    """Percent-decoding as a URI reader does it: ``+`` stays and stray ``%`` stays."""
    guarded = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(guarded), text)


def safe_label(label: Column) -> Column:
    """Whether a logical label carries neither credentials nor a local path."""
    decoded = unquote(label)
    return ~(
        decoded.rlike(UNSAFE_LABEL)
        | decoded.startswith("/")
        | decoded.startswith("\\")
        | decoded.rlike(UNSAFE_LABEL_PATH)
    )


def item_id_problem(identity: Column) -> Column:
    """Whether a batch item identifier is malformed or reserved."""
    return F.coalesce(
        ~identity.rlike(ITEM_ID) | F.upper(identity).isin(RESERVED_IDS), F.lit(True)
    )


def relative_path_problem(path: Column) -> Column:
    """Whether a batch input path is blank, absolute or drive-qualified."""
    return F.coalesce(
        is_blank(path)
        | path.contains("\x00")
        | path.startswith("/")
        | path.startswith("\\")
        | path.rlike("^[A-Za-z]:"),
        F.lit(True),
    )


def any_of(tests: list[Column]) -> Column:
    """Logical OR of several tests."""
    return reduce(lambda a, b: a | b, tests)
