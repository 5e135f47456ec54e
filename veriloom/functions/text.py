"""Scalar expressions over strings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(text: Column) -> Column:
    """True for null, empty, or white space only (all Unicode white space counts)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") == ""


def slug(text: Column) -> Column:
    """Lower case; runs outside ``[a-z0-9.-]`` become ``-``; trimmed of ``-``; ``x`` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("x")).otherwise(out)


def slug_letters(text: Column) -> Column:
    """Each character that is no letter or digit becomes ``-``; case stays."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "-")


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value: a run is written as its length in ten digits and its digits, without leading zeros.

    Parts end with a NUL, so that a part sorts before those that continue it.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)

    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, key), "\0")


def leading_number(segment: Column) -> Column:
    """The digits that a segment starts with, as a number; 0 if there are none."""
    return F.coalesce(F.expr("0").cast("bigint") + F.nullif(F.regexp_extract(segment, r"^\d+", 0), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def version_bump(old: Column, new: Column) -> Column:
    """``major`` or ``minor`` where the first or second dotted segment differs, else ``patch`` (also for equal versions).

    Segments count by the digits that they start with; missing ones count as 0.
    """
    a, b = F.split(old, r"\."), F.split(new, r"\.")
    part = lambda v, i: leading_number(F.coalesce(F.get(v, F.lit(i)), F.lit("0")))
    return F.when(part(a, 0) != part(b, 0), "major").when(part(a, 1) != part(b, 1), "minor").otherwise("patch")


#: Order of bumps, least first.
BUMPS = ("patch", "minor", "major")


def update_policy(mode: Column, old: Column, new: Column, most: Column) -> Column:
    """``struct<decision, reason, surfaced>`` for an update from ``old`` to ``new``.

    Decisions are ``drive``, ``defer`` and, for an unknown mode, ``abort``; auto
    drives bumps up to ``most``.  Decisions and reasons are fixed values.
    ``surfaced``: whether the version is shown.
    """
    bump = version_bump(old, new)
    rank = lambda c: F.array_position(F.array(*map(F.lit, BUMPS)), c)
    fits = (mode == "auto") & (rank(bump) <= rank(most))
    decision = F.when(fits, "drive").when(mode.isin("auto", "notify", "off"), "defer").otherwise("abort")
    reason = (
        F.when(fits, F.concat(F.lit("policy=auto, bump="), bump, F.lit(" within "), most))
        .when(mode == "auto", F.concat(F.lit("policy=auto but bump="), bump, F.lit(" exceeds "), most))
        .when(mode == "notify", F.lit("policy=notify: surfaced, not driven")).when(mode == "off", F.lit("policy=off: recorded only"))
        .otherwise(F.concat(F.lit("unknown updater policy: '"), F.coalesce(mode, F.lit("")), F.lit("'")))
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"), (mode.eqNullSafe("notify") | (mode.eqNullSafe("auto") & ~F.coalesce(fits, F.lit(False)))).alias("surfaced"))


#: MIME types by file extension.
MIME = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "html": "text/html", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf"}


def mime_type(path: Column) -> Column:
    """MIME type by extension; unknown ones are octet streams."""
    out = F.lit("application/octet-stream")
    for ext, kind in MIME.items():
        out = F.when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == ext, F.lit(kind)).otherwise(out)
    return out


def within(path: Column, root: Column) -> Column:
    """Whether a normalised path is ``root`` or lies below it, by whole components."""
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1")
    top = F.regexp_replace(F.regexp_replace(root, "/+", "/"), "(.)/$", "$1")
    return ~clean.rlike(r"(^|/)\.\.(/|$)") & ((clean == top) | F.startswith(clean, F.concat(F.when(top == "/", F.lit("")).otherwise(top), F.lit("/"))))


def minted() -> Column:
    """A new random identifier (UUID 4) for each row: another one in each run, so rows that carry it must be written once."""
    return F.uuid()
