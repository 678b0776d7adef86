"""Text scalars: normalisation, tokens, edit distance and the caption variant rules.

Unicode composition and case folding use the ICU classes that ship with Spark, reached by
``reflect``, so no row leaves the JVM for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The whitespace class of the source data (Unicode White_Space and the four
# information separators), the Hangul syllable block, protected tokens and slot letters.
WHITESPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
HANGUL = r"[가-힣]"
PROTECTED = r"[A-Za-z]+|\p{Nd}+(?:[.:]\p{Nd}+)?"
NUMBER = r"\p{Nd}+(?:[.:]\p{Nd}+)?"
SLOT_LETTER = r"(?i)(?<![A-Za-z])[QWERDF](?![A-Za-z])"
MIN_CONFIDENCE = 0.5
MIN_LATIN_CONFIDENCE = 0.6
CONSERVATIVE_EDIT_RATIO = 0.2
TEMPORAL_EDIT_RATIO = 0.45


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _compose(c: Column) -> Column:
    """Only text with a letter from the combining marks on can change."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x{2FF}]"), composed).otherwise(c)


def _fold(c: Column) -> Column:
    """ASCII is folded by lowering it."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(c))


def nfc(text: Column | str) -> Column:
    """Canonical composition; null stays null."""
    c = col(text)
    return F.when(c.isNotNull(), _compose(c))


def fold_case(text: Column | str) -> Column:
    """Full Unicode case folding (sharp s becomes ss); null stays null."""
    c = col(text)
    return F.when(c.isNotNull(), _fold(c))


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` over values that are evaluated once per row, however often it uses them."""
    bound = F.struct(*[v.alias(name) for name, v in values.items()])
    return F.transform(F.array(bound), lambda s: body(*[s[name] for name in values]))[0]


def trim_space(text: Column | str) -> Column:
    """Trim the whole whitespace class on both sides (``trim`` only knows the blank)."""
    return F.regexp_replace(col(text), rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(text: Column | str) -> Column:
    """True for null and for text of whitespace only."""
    return F.coalesce(~col(text).rlike(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]"), F.lit(True))


def remove_whitespace(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"{WHITESPACE}+", "")


def normalize_for_comparison(text: Column | str) -> Column:
    """Composed text without any whitespace; every other character is kept."""
    return remove_whitespace(nfc(text))


def normalize_text(text: Column | str) -> Column:
    """Composed text with LF line ends; spaces and punctuation are kept."""
    return nfc(F.regexp_replace(col(text), "\r\n|\r", "\n"))


def dictionary_key(text: Column | str, *, trimmed: bool = True) -> Column:
    c = col(text)
    key = F.when(c.isNotNull(), _fold(_compose(c)))
    return trim_space(key) if trimmed else key


def clean_name(html: Column | str) -> Column:
    return trim_space(F.regexp_replace(col(html), "<[^>]+>", ""))


def edit_distance(left: Column | str, right: Column | str) -> Column:
    return F.levenshtein(col(left), col(right))


def within_edits(left: Column, right: Column, allowed: Column) -> Column:
    """``edit_distance <= allowed`` with the length difference tested first, as it is free."""
    return F.when(F.abs(F.length(left) - F.length(right)) > allowed, F.lit(False)).otherwise(
        F.levenshtein(left, right) <= allowed
    )


def is_low_information(text: Column | str, confidence: Column | str) -> Column:
    """Readings to reject: unsure ones, and short or unsure ones without any Hangul."""
    c, trust = col(text), col(confidence)
    letters = F.length(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return (
        F.when(trust.isNull() | (trust < MIN_CONFIDENCE), F.lit(True))
        .when(nfc(c).rlike(HANGUL), F.lit(False))
        .otherwise((letters < 2) | (trust < MIN_LATIN_CONFIDENCE))
    )


def protected_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(PROTECTED), F.lit(0))


def numbers_of(composed: Column) -> Column:
    return F.regexp_extract_all(composed, F.lit(NUMBER), F.lit(0))


def slots_of(composed: Column) -> Column:
    return F.transform(F.regexp_extract_all(composed, F.lit(SLOT_LETTER), F.lit(0)), F.upper)


def number_tokens(text: Column | str) -> Column:
    return numbers_of(nfc(text))


def slot_tokens(text: Column | str) -> Column:
    return slots_of(nfc(text))


def _allowed_edits(left: Column, right: Column, ratio: float) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.greatest(F.lit(1), F.floor(longest * F.lit(ratio)).cast("int"))


def _conservative(a: Column, b: Column, script: str) -> Column:
    """The rule on composed texts without whitespace."""
    return (
        F.when(a == b, F.lit(True))
        .when(~a.rlike(script) | ~b.rlike(script), F.lit(False))
        .when(F.greatest(F.length(a), F.length(b)) < 4, F.lit(False))
        .when(protected_tokens(a) != protected_tokens(b), F.lit(False))
        .otherwise(within_edits(a, b, _allowed_edits(a, b, CONSERVATIVE_EDIT_RATIO)))
    )


def conservative_variants(left: Column | str, right: Column | str, script: str = HANGUL) -> Column:
    """Equal without whitespace, or a few edits apart with the same protected tokens."""
    return let(
        lambda a, b: _conservative(a, b, script), a=normalize_for_comparison(left), b=normalize_for_comparison(right)
    )


def _contradict(left: Column, right: Column) -> Column:
    return (F.size(left) > 0) & (F.size(right) > 0) & (left != right)


def temporal_variants(left: Column | str, right: Column | str, script: str = HANGUL) -> Column:
    """The looser rule for neighbours in time: compares only the letters of ``script``."""
    outside = "[^" + script[1:]

    def rule(x: Column, y: Column) -> Column:
        a, b = F.regexp_replace(x, outside, ""), F.regexp_replace(y, outside, "")
        return (
            F.when(_conservative(remove_whitespace(x), remove_whitespace(y), script), F.lit(True))
            .when(F.least(F.length(a), F.length(b)) < 2, F.lit(False))
            .when(_contradict(numbers_of(x), numbers_of(y)), F.lit(False))
            .when(_contradict(slots_of(x), slots_of(y)), F.lit(False))
            .otherwise(within_edits(a, b, _allowed_edits(a, b, TEMPORAL_EDIT_RATIO)))
        )

    return let(rule, x=nfc(left), y=nfc(right))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null when the whole is zero."""
    return F.when(whole != 0, part / whole)


def row_metrics(truth: Column | str, output: Column | str, *, normalize: bool = True) -> dict[str, Column]:
    """Edit metrics of one reading against its truth; a missing output counts as empty."""
    a, b = col(truth), F.coalesce(col(output), F.lit(""))
    if normalize:
        a, b = normalize_text(a), normalize_text(b)
    bare_a, bare_b = remove_whitespace(a), remove_whitespace(b)
    edits, bare_edits = F.levenshtein(a, b), F.levenshtein(bare_a, bare_b)
    return {
        "edits": edits,
        "characters": F.length(a),
        "cer": ratio(edits, F.length(a)),
        "whitespace_free_edits": bare_edits,
        "whitespace_free_characters": F.length(bare_a),
        "whitespace_free_cer": ratio(bare_edits, F.length(bare_a)),
        "exact": a == b,
    }
