"""Words of a text, cut at byte level, and other small helpers the operators share."""

from __future__ import annotations

import hashlib

import numpy as np

# Words are runs of 0-9, a-z and bytes above 0x7F after A-Z is lower-cased; any other byte parts them.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
# Only A-Z is lower-cased; bytes.split() parts at exactly space, \t, \n, \v, \f and \r.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and any non-ASCII characters. Null and empty texts have none."""
    return text.encode().translate(_ALNUM).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased. Null and empty texts have none."""
    return text.encode().translate(_LOWER).split() if text else []


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores as it takes to clash with no column."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LONGEST = 64  # bytes of a word up to which it is hashed by sums
_LETTER = mix(np.arange(1, 257, dtype=np.uint64)) * ~_BLANK
_PLACE = np.cumprod(np.full(_LONGEST + 1, 0x9E3779B97F4A7C15, np.uint64))


def blank_word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the `blank_words` of all texts in a row, and how many each text has.

    A letter counts by its value and its place in the word, so whole arrays of bytes are hashed at once; words
    longer than 64 bytes are hashed by themselves. Equal in every process.
    """
    import xxhash

    parts = [(t or "").encode().translate(_LOWER) for t in texts]
    raw = b" ".join([*parts, b""]) or b" "
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    first = ~blank & np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.arange(len(data), dtype=np.int32)
    place = np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), _LONGEST)
    value = mix(np.add.reduceat(_LETTER[data] * _PLACE[place], starts))
    stop = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    for i in np.flatnonzero(stop - starts > _LONGEST).tolist():
        value[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : stop[i]])
    return value, counts
