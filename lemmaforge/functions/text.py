"""Script-aware text expressions: white space, tokens, scripts, clauses, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lemmaforge.functions.keys import col, lower_simple

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
WORD_RUN = rf"[\p{{L}}\p{{Nd}}&&[^{CJK}]]+"
RARE_BLANK = r"\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = f"[ {RARE_BLANK}]"

# Places where one clause ends and the next begins.
CLAUSE_BREAKS = "\n。．.；;！!？?、,，:：（）()「」『』【】〔〕[]/／·・…—–\t "


def single_blanks(value: Column | str) -> Column:
    """Runs of white space, zero-width space and BOM to single blanks. What is a single blank already is not replaced."""
    # the ranges of printable letters come first: most letters are in them, and the class is dear to test
    return F.regexp_replace(col(value), f"(?![ -~])[{RARE_BLANK}]{BLANK}*| (?![!-~]){BLANK}+", " ")


def collapse_space(value: Column | str) -> Column:
    """White space, zero-width space and BOM to single blanks, trimmed."""
    return F.trim(single_blanks(value))


def compare_form(value: Column | str) -> Column:
    return lower_simple(collapse_space(value))


def find_all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


# no CJK letter stands below this code point; a plain range is far cheaper to test than script classes
BEYOND = r"[\x{1100}-\x{10FFFF}]"


def tokens(value: Column | str) -> Column:
    """V1: words of letters and digits; CJK runs as two-letter pieces."""
    text = lower_simple(value)
    runs = find_all(text, f"[{CJK}]+")
    pieces = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
                F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
            ),
        )
    )
    return F.when(col(value).rlike(BEYOND), F.concat(find_all(text, WORD_RUN), pieces)).otherwise(
        find_all(text, r"[\p{L}\p{Nd}]+")
    )


def count_class(value: Column | str, letters: str, above: str | None = None) -> Column:
    """Number of characters of a regular-expression class.

    `above` is a code point below which the class has none: texts without any
    character from there on are not searched.
    """
    text = col(value)
    count = (F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]+", ""))).cast("bigint")
    if above is None:
        return count
    return F.when(text.rlike(rf"[\x{{{above}}}-\x{{10FFFF}}]"), count).otherwise(F.lit(0).cast("bigint"))


# Scripts told apart, in tie-break order.
SCRIPTS = ["han", "kana", "hangul", "latin", "cyrillic", "arabic", "other"]


def script_tally(value: Column | str) -> dict[str, Column]:
    """Letters per script; `other` is what the named scripts leave over."""
    text = col(value)
    tally = {
        "han": count_class(text, r"\p{IsHan}", "1100"),
        "kana": count_class(text, r"\p{IsHiragana}\p{IsKatakana}", "1100"),
        "hangul": count_class(text, r"\p{IsHangul}", "1100"),
        "latin": count_class(text, r"\p{L}&&\p{IsLatin}"),
        "cyrillic": count_class(text, r"\p{IsCyrillic}", "0370"),
        "arabic": count_class(text, r"\p{IsArabic}", "0370"),
    }
    tally["other"] = count_class(
        text, rf"\p{{L}}&&[^{CJK}\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsArabic}}]", "0080"
    )
    return tally


def dominant_of(tally: dict[str, Column]) -> Column:
    """Script with at least a third of the letters, else mixed."""
    total = sum(tally.values(), F.lit(0))
    best = F.greatest(*tally.values())
    name = F.coalesce(*[F.when(count == best, script) for script, count in tally.items()])
    return F.when((total == 0) | (best * 3 < total), "mixed").otherwise(name)


def present_of(tally: dict[str, Column]) -> Column:
    """Scripts with at least a twentieth of the letters."""
    total = sum(tally.values(), F.lit(0))
    return F.array_compact(
        F.array(*[F.when((total > 0) & (n * 20 >= total), script) for script, n in tally.items()])
    )


def dominant_script(value: Column | str, purity: float = 0.8) -> Column:
    """Latin, cjk or mixed by letter share; empty without letters."""
    text = col(value)
    cjk = count_class(text, CJK, "1100")
    latin = count_class(text, rf"\p{{L}}&&[^{CJK}]")
    total = latin + cjk
    return (
        F.when(total == 0, "")
        .when(latin / total >= purity, "latin")
        .when(cjk / total >= purity, "cjk")
        .otherwise("mixed")
    )


def mixes_scripts(value: Column | str) -> Column:
    """At least four plain Latin letters beside at least two CJK characters."""
    return (count_class(value, CJK, "1100") >= 2) & (count_class(value, "A-Za-z") >= 4)


def clause_counts(value: Column | str) -> tuple[Column, Column]:
    """(Han-only clauses of four or more Han characters, clauses with CJK). Texts without any such letter are not split."""
    breaks = "[" + "".join("\\" + c if c in "[]()./?-" else c for c in CLAUSE_BREAKS) + "]+"
    clauses = F.filter(F.split(col(value), breaks), lambda c: c.rlike(f"[{CJK}]"))
    chinese = F.filter(
        clauses,
        lambda c: (F.length(F.regexp_replace(c, r"\P{IsHan}", "")) >= 4)
        & ~c.rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"),
    )
    some = col(value).rlike(BEYOND)
    return tuple(F.when(~some, F.lit(0)).otherwise(F.size(kept)).cast("bigint") for kept in (chinese, clauses))


def truncated(value: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit(mark))).otherwise(value)


def slug(value: Column | str, limit: int = 32) -> Column:
    """Stable file-name form of a title."""
    text = F.regexp_replace(lower_simple(value), r"[^\p{L}\p{Nd}]+", "-")
    cut = F.regexp_replace(F.left(F.regexp_replace(text, "^-+", ""), F.lit(limit)), "-+$", "")
    return F.when(cut == "", "entry").otherwise(cut)


def headword_identity(value: Column | str) -> Column:
    return F.regexp_replace(lower_simple(value), r"[^\p{L}\p{Nd}]", "")


def headword_matches_key(headword: Column | str, key: Column | str) -> Column:
    """Letters and digits only, one a prefix of the other; an empty side matches."""
    left, right = headword_identity(headword), headword_identity(key)
    return (left == "") | (right == "") | F.startswith(left, right) | F.startswith(right, left)


def distinct_folded(items: Column) -> Column:
    """First-seen distinct values of an array, case ignored."""
    tagged = F.transform(items, lambda x, i: F.struct(F.lower(x).alias("f"), i.alias("i"), x.alias("x")))
    kept = F.filter(
        tagged, lambda t: F.array_position(F.transform(items, lambda y: F.lower(y)), t["f"]) == t["i"] + 1
    )
    return F.transform(kept, lambda t: t["x"])
