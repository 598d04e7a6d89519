"""Credential redaction of text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Replacement texts, token markers, characters of a token, size.
PLACEHOLDER = "[redacted]"
KEY_MATERIAL = "-----BEGIN"
KEY_MATERIAL_TEXT = "[redacted: message contained private key material]"
MARKERS = ("ya29.", "AIza", "gho_", "ghp_", "ghs_", "ghu_", "eyJ", "1//")
TOKEN_CHARACTERS = r"[A-Za-z0-9\-_./+=]"
WHITESPACE = r" \t\n\f\r"
MAX_BYTES = 512
ELLIPSIS = "…"

_MARK = "\uffff"
_MARKER_RUN = "(?:" + "|".join(m.replace(".", r"\.") for m in MARKERS) + ")" + TOKEN_CHARACTERS + "*"
_AFTER_BEARER = f"([Bb]earer)([{WHITESPACE}]*)(?:{TOKEN_CHARACTERS}+|[^{WHITESPACE}])"
# Looking at one character first rejects most positions without trying a branch.
_FIRST = "".join(sorted({m[0] for m in MARKERS} | set("Bb")))
PATTERN = f"(?=[{_FIRST}])(?:{_AFTER_BEARER}|{_MARKER_RUN})"


def redact(text: Column | str, max_bytes: int | None = None) -> Column:
    """Replace whatever looks like a credential.

    Text with private key material is replaced whole. Elsewhere a token that
    starts with a known marker, and the value after ``Bearer``, become
    ``[redacted]``. With ``max_bytes`` (:data:`MAX_BYTES` suits an error message)
    the result is cut there, never inside a character. All built-in expressions, one regex
    pass.
    """
    source = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(source, F.lit(PATTERN), F.lit(f"$1$2{_MARK}"))
    finish = _spell_out if max_bytes is None else lambda m: _cut(m, max_bytes)
    return F.when(F.contains(source, F.lit(KEY_MATERIAL)), F.lit(KEY_MATERIAL_TEXT)).otherwise(_once(marked, finish))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` a single time, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _spell_out(marked: Column) -> Column:
    return F.replace(marked, F.lit(_MARK), F.lit(PLACEHOLDER))


def _cut(marked: Column, size: int) -> Column:
    """Cut as soon as an ordinary character reaches the limit.

    Placeholders and "Bearer" at the very end may exceed it. Only the first
    ``size`` characters can matter for the result, as each is a byte or more.
    """
    ordinary = F.regexp_replace(marked, F.lit(f"(?:{_MARK}|[Bb]earer)+\\z"), F.lit(""))
    reaches = F.octet_length(_spell_out(ordinary)) >= size
    start = F.encode(_spell_out(F.left(marked, F.lit(size))), "UTF-8")
    return F.when(reaches, F.concat(_once(start, lambda raw: _first_bytes(raw, size)), F.lit(ELLIPSIS))).otherwise(
        _spell_out(marked)
    )


def _first_bytes(raw: Column, size: int) -> Column:
    """The longest prefix of at most ``size`` bytes made of whole characters."""
    prefixes = [F.substring(raw, 1, size - back).cast("string") for back in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(p), p) for p in prefixes])
