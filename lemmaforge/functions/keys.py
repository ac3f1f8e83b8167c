"""Key, selector, redirect and reference expressions (all built-in columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a regular-expression class.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Superscript digits in the order 0 to 9.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"

# MIME types by file extension.
MIME_TYPES = {
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".ogg": "audio/ogg",
    ".spx": "audio/wav",
    ".m4a": "audio/mp4",
    ".aac": "audio/aac",
    ".flac": "audio/flac",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".css": "text/css; charset=utf-8",
    ".js": "application/javascript; charset=utf-8",
}
AUDIO_EXTENSIONS = [".mp3", ".wav", ".ogg", ".spx", ".m4a", ".aac", ".flac"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp"]


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_space(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"^{SPACE}+|{SPACE}+$", "")


def nfc(value: Column | str) -> Column:
    """Unicode NFC, inside the JVM, and only where a non-ASCII letter occurs."""
    text = col(value)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def lower_simple(value: Column | str) -> Column:
    """Lower case by single-character mapping.

    Dotted capital I and capital sigma are mapped first: the JVM maps them by
    context to other letters than a per-character mapping does.
    """
    return F.lower(F.replace(F.replace(col(value), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def norm_key(value: Column | str) -> Column:
    """Trimmed, NFC, case kept."""
    return nfc(trim_space(value))


def fold_key(value: Column | str) -> Column:
    """Lower case of the normal key."""
    return lower_simple(norm_key(value))


def join_key(fold: Column | str) -> Column:
    """Idempotent form of a fold key.

    Lower-casing may undo composition of rare letters; composing once more
    makes equal every pair that any lookup tier could match.
    """
    return nfc(fold)


def selector_base_ordinal(value: Column | str) -> tuple[Column, Column]:
    """`word²`, `word^2`, `word^{2}` to (word, 2); NULLs where not a selector."""
    text = trim_space(value)
    raised = F.regexp_extract(text, rf"(?s)^(.*?)([{SUPERSCRIPTS}]+)$", 2)
    caret = F.regexp_extract(text, r"(?s)^(.*?)\^(?:\{([0-9]+)\}|([0-9]+))$", 2)
    caret_bare = F.regexp_extract(text, r"(?s)^(.*?)\^(?:\{([0-9]+)\}|([0-9]+))$", 3)
    digits = F.when(raised != "", F.translate(raised, SUPERSCRIPTS, "0123456789")).otherwise(
        F.concat(caret, caret_bare)
    )
    base = F.when(
        raised != "", F.regexp_extract(text, rf"(?s)^(.*?)([{SUPERSCRIPTS}]+)$", 1)
    ).otherwise(F.regexp_extract(text, r"(?s)^(.*?)\^(?:\{([0-9]+)\}|([0-9]+))$", 1))
    base = trim_space(base)
    number = digits.try_cast("bigint")
    good = (digits != "") & (base != "") & (number >= 1)
    return F.when(good, base), F.when(good, number)


def link_target(content: Column | str) -> Column:
    """Redirect target, or NULL when the content is an ordinary record."""
    text = F.regexp_replace(
        col(content), r"^[\x00\x{FEFF} \t\r\n]+|[\x00\x{FEFF} \t\r\n]+$", ""
    )
    target = F.regexp_extract(text, r"(?s)^(?:@@@LINK=|@@LINK=)(.*)$", 1)
    target = F.regexp_replace(target, r"^[\x00 \t\r\n]+|[\x00 \t\r\n]+$", "")
    return F.when(target != "", target)


def resource_key(ref: Column | str) -> Column:
    """P5: canonical resource reference."""
    text = F.regexp_replace(trim_space(ref), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    text = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    text = F.regexp_replace(F.regexp_replace(text, "^/", ""), r"(?s)[?#].*$", "")
    return lower_simple(text)


def base_name(path: Column | str) -> Column:
    """Last element of a path, trailing slashes ignored; empty path gives `.`."""
    text = col(path)
    stripped = F.regexp_replace(text, "/+$", "")
    name = F.element_at(F.split(stripped, "/"), -1)
    return F.when(text == "", F.lit(".")).when(stripped == "", F.lit("/")).otherwise(name)


def extension(path: Column | str) -> Column:
    """Suffix from the last dot of the last path element, dot included."""
    return F.regexp_extract(col(path), r"(\.[^./]*)$", 1)


def resource_candidates(ref: Column | str) -> Column:
    """Keys to try, most specific first; NULL for an empty reference."""
    primary = resource_key(ref)
    base = base_name(primary)
    both = F.when(
        (base != primary) & ~base.isin(".", "/"), F.array(primary, base)
    ).otherwise(F.array(primary))
    return F.when(primary != "", both)


def is_audio_ref(ref: Column | str) -> Column:
    return F.lower(extension(resource_key(ref))).isin(AUDIO_EXTENSIONS)


def is_image_ref(ref: Column | str) -> Column:
    return F.lower(extension(resource_key(ref))).isin(IMAGE_EXTENSIONS)


def is_speex_ref(ref: Column | str) -> Column:
    return F.lower(extension(resource_key(ref))) == ".spx"


def mime_type(ref: Column | str) -> Column:
    """Content type by extension."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(
        F.element_at(table, F.lower(extension(resource_key(ref)))),
        F.lit("application/octet-stream"),
    )


# Schemes and bare suffixes reported for references, tried in this order.
SCHEMES = ["sound:", "snd:", "entry:", "file:", "bword:", "http:", "https:"]
BARE_AUDIO = [".mp3", ".spx", ".wav", ".ogg"]
BARE_IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return text.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def reference_scheme(value: Column | str) -> Column:
    """Scheme of a reference, else bare-audio, bare-image or the empty string."""
    text = F.lower(trim_space(value))
    scheme = F.regexp_extract(text, "^(" + "|".join(SCHEMES) + ")//", 1)
    path = F.regexp_replace(text, r"(?s)[?#].*$", "")
    return (
        F.when(scheme != "", scheme)
        .when(ends_with_any(path, BARE_AUDIO), "bare-audio")
        .when(ends_with_any(path, BARE_IMAGE), "bare-image")
        .otherwise("")
    )


def clean_path(path: Column) -> Column:
    """Resolve `.`, `..` and empty elements of a relative path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(resolved, "/")


def stylesheet_path(ref: Column | str) -> Column:
    """Local style sheet path, NULL for remote, inline or escaping ones."""
    text = trim_space(ref)
    remote = F.lower(text).rlike(r"://|^data:|^//")
    path = F.replace(F.regexp_replace(text, r"(?s)[?#].*$", ""), F.lit("\\"), F.lit("/"))
    path = clean_path(F.regexp_replace(path, "^/+", ""))
    good = (text != "") & ~remote & F.lower(extension(path)).eqNullSafe(".css") & ~path.rlike(r"^\.\.(/|$)")
    return F.when(good, path)
