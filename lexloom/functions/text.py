"""Column builders for text: normalising, tokenising, case, numbers, detokenising, recognisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
#: ASCII punctuation but the hyphen.
PUNCTUATION = r"""[!"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~]"""
#: Titles, company suffixes, vowels and consonants, marks that a token is skipped for.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof")
SUFFIXES = ("Inc", "Ltd", "Corp", "Co")
VOWELS = "eiöüEİÖÜîÎaıouAIOUâÂûÛ"
CONSONANTS = "bdcgvzjfğlmnrwyBDCGVZJFĞLMNRWYptçkfsşhPTÇKFSŞH"


SKIPPED_MARKS = ".,!?;:-—()\"'"


def is_skipped_mark(word: Column) -> Column:
    """Whether a token is a run of these marks as they stand in the list."""
    return F.contains(F.lit(SKIPPED_MARKS), word)


def lower_word_runs(text: Column) -> Column:
    """A dictionary line in lower case; only word characters have any."""
    return F.lower(text)


def tokens(text: Column) -> Column:
    """Pieces between runs of white space; none of an empty text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def clean_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), NOT_WORD, "")


def turkish_lower(text: Column) -> Column:
    """Lower case in which the dotted capital becomes a plain i."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def dotted_fold(text: Column) -> Column:
    """Lower case by Turkish rules: I to dotless, the dotted capital to i."""
    return F.lower(F.replace(F.replace(text, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def case_like(model: Column, text: Column) -> Column:
    """Text in the case pattern of a model: all upper, first upper, or as it is."""
    first = F.left(model, F.lit(1))
    whole = (model == F.upper(model)) & (model != F.lower(model))
    return F.when(whole, F.upper(text)).when((first == F.upper(first)) & (first != F.lower(first)), capitalize(text)).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def with_code(code: Column, text: Column) -> Column:
    return F.concat_ws(" ", code, text)


def aligner_line(source: Column, target: Column) -> Column:
    return F.concat_ws(" ||| ", source, target)


def first_token(text: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.get(tokens(text), F.lit(0)), F.lit(default))


def code_in_parentheses(name: Column) -> Column:
    return F.regexp_extract(name, r"\(([^)]*)\)", 1)


def base_name(name: Column) -> Column:
    return F.trim(F.substring_index(name, "(", 1))


def fallback_code(name: Column) -> Column:
    """First three letters, or ``und``."""
    letters = F.regexp_replace(name, "[^a-zA-Z]", "")
    return F.when(letters == "", "und").otherwise(F.lower(F.left(letters, F.lit(3))))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def shorten(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def is_number(token: Column) -> Column:
    """Digits with at most one dot."""
    return token.rlike(r"^\p{Nd}*\.?\p{Nd}*$") & token.rlike(r"\p{Nd}")


def split_base(token: Column) -> tuple[Column, Column]:
    """What comes before the first hyphen, and the rest with it (or nothing)."""
    base = F.substring_index(token, "-", 1)
    return base, F.substr(token, F.length(base) + 1)


def lower_words(text: Column) -> Column:
    """The first character, then the leading letters of each later word, in lower case."""
    lead = "^([A-Za-zŞÇÖĞÜİı]+)"

    def one(t: Column, i: Column) -> Column:
        run = F.regexp_extract(t, lead, 1)
        later = F.concat(F.lower(run), F.substr(t, F.length(run) + 1))
        return F.when(i == 0, F.concat(F.lower(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))).otherwise(later)

    return F.array_join(F.transform(tokens(text), one), " ")


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def join_pieces(text: Column) -> Column:
    """Subword pieces marked with a low line block, as plain words."""
    return collapse(F.replace(text, F.lit("▁"), F.lit(" ")))


def fix_punctuation(text: Column, lang: str = "en") -> Column:
    rules = [(r" ([.,!?:;)\]}])", "$1"), (r"([({\[]) ", "$1")]
    if lang in ("en", "de", "es", "it"):
        rules += [(' " ', ' "'), (" ' ", " '")]
    return _chain(text, [*rules, (r" \. \. \.", "..."), (r"\. \. \.", "...")])


def fix_numbers(text: Column) -> Column:
    """Decimals, thousands, dates, times and percentages without inner spaces."""
    return _chain(text, [
        (r"(\d) \. (\d)", "$1.$2"), (r"(\d) , (\d)", "$1,$2"), (r"(\d{1,4}) / (\d{1,2}) / (\d{1,4})", "$1/$2/$3"),
        (r"(\d{1,4}) - (\d{1,2}) - (\d{1,4})", "$1-$2-$3"), (r"(\d{1,2}) : (\d{2})", "$1:$2"), (r"(\d) %", "$1%"),
    ])


def fix_names(text: Column) -> Column:
    """Initials, titles and company suffixes with their dots."""
    initials = [(r"([A-Z]) \. ([A-Z]) \. ([A-Z]) \.", "$1.$2.$3."), (r"([A-Z]) \. ([A-Z]) \.", "$1.$2.")]
    return _chain(text, initials + [(rf"{w} \.", f"{w}.") for w in TITLES + SUFFIXES])


def detokenize(text: Column, lang: str = "en", numbers: bool = True, names: bool = True) -> Column:
    out = fix_punctuation(join_pieces(text), lang)
    out = fix_numbers(out) if numbers else out
    return fix_names(out) if names else out


def simple_detokenize(text: Column) -> Column:
    out = text
    for mark in (".", ",", "!", "?", ":", ";"):
        out = F.replace(out, F.lit(f" {mark}"), F.lit(mark))
    return out


def consistency(before: Column, after: Column) -> dict[str, Column]:
    """What detokenising left behind, and whether it kept the alphanumeric content."""
    content = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    out = {
        "marks_left": F.regexp_count(after, F.lit("▁")).cast("long"),
        "double_spaces": F.regexp_count(after, F.lit("  +")).cast("long"),
        "bad_punctuation": F.regexp_count(after, F.lit(" [.,!?:;]")).cast("long"),
        "content_preserved": content(before) == content(after),
    }
    sound = (out["marks_left"] == 0) & (out["double_spaces"] == 0) & (out["bad_punctuation"] == 0)
    return out | {"is_consistent": sound & out["content_preserved"]}


def split_punctuation(text: Column) -> Column:
    """A token for each word and mark; marks between digits stay."""
    marks = "-+“‘”\"/()*?!;.:,"
    inside = "\\-+“‘”\"/()*?!;.:,"
    out = _chain(text, [
        (f"([^ \\t])([{inside}])", "$1 $2"), (f"([{inside}])([^ \\t])", "$1 $2"), (r"([0-9]) +([.,:]) +([0-9])", "$1$2$3"),
        (r"([ \t])([`'])([^ \t])", "$1$2 $3"), (r"([^ \t])(['’])([ \t])", "$1 $2$3"),
    ])
    assert len(marks) == len(inside) - 1
    return F.filter(F.split(out, r"[ \t]+"), lambda t: t != "")


def hyphenate(word: Column) -> Column:
    """Hyphens between vowels, and before a consonant that a vowel follows."""
    apostrophe = "['’]?"
    out = F.regexp_replace(word, f"([{VOWELS}])(?={apostrophe}[{VOWELS}])", "$1-")
    return F.regexp_replace(out, f"([{VOWELS}][{CONSONANTS}'’]*?)(?={apostrophe}[{CONSONANTS}]{apostrophe}[{VOWELS}])", "$1-")


#: Patterns of addresses.
URL = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"<>]*)?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"


def ascii_fold(text: Column) -> Column:
    """Circumflex and Turkish letters as plain ones."""
    return F.translate(text, "âîûÂÎÛçğıöşüÇĞİÖŞÜ", "aiuAIUcgiosuCGIOSU")
