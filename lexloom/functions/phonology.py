"""Column builders for Turkish words: syllables, sounds, spellings, tokens and number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.metrics import let
from lexloom.functions.text import ascii_fold

#: The alphabet's capitals and small letters, vowels by kind, and consonants.
CAPITALS, SMALL = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZÎÛÂ", "abcçdefgğhıijklmnoöprsştuüvyzîûâ"
FRONT, BACK, ROUND = "eiöüî", "aıouâû", "öüouû"
PALATAL, VOWEL, CONSONANT = FRONT + "âû", FRONT + BACK, "bdcgvzjfğlmnrwyptçksşh"
#: Sounds between a sound and what it depends on, at most: looking behind needs an end, and no syllable, nor
#: run of consonants, is that long.
BEFORE = 250
#: Sounds by rule, in the order in which rules apply. Rules look at the syllable (no dot
#: between) or at neighbours; a colon is length.
SOUNDS = (
    ("j", "ʒ"), ("y", "j"), ("ç", "tʃ"), ("ş", "∫"), ("c", "dʒ"),
    (f"k(?:(?=[^.]*[{PALATAL}])|(?<=[{PALATAL}][^.]{{0,{BEFORE}}}k))", "c"),
    (f"g(?:(?=[^.]*[{PALATAL}])|(?<=[{PALATAL}][^.]{{0,{BEFORE}}}g))", "ɟ"),
    (f"l(?:(?=[^.]*[{PALATAL}])|(?<=[{PALATAL}][^.]{{0,{BEFORE}}}l))", "ł"),
    (f"(tʃ|dʒ|[ptkc])(?=[{VOWEL}]|$)", "$1ʰ"),
    (f"v(?<=[{ROUND}][^{VOWEL}]{{0,{BEFORE}}}v)$|^v(?=[^{VOWEL}]*[{ROUND}])", "β"),
    (f"v(?:(?<=[{ROUND}][^{VOWEL}]{{0,{BEFORE}}}v)|(?=[^{VOWEL}]*[{ROUND}]))", "ω"),
    (f"h(?=[{FRONT}])|(?<=[{FRONT}])h(?=[{CONSONANT}]|$)", "ç"),
    (f"(?<=[{BACK}])h(?=[{CONSONANT}]|$)", "x"),
    (f"(?<=[{BACK}])n(?=[kg])", "ŋ"), (f"(?<=[{FRONT}])n(?=[cɟ])", "ɲ"), ("r$", "ɾ"),
    (r"ğ(?=\.|$)", ":"), (f"(?<=([{VOWEL}]))ğ(?=\\1)", ":"), (f"(?<=[{VOWEL}])ğ(?=[{VOWEL}])", ""), ("ğ", "γ"),
    ("â", "ạ"), ("î", "i"), ("û", "u"), ("a", "ɑ"), ("e$", "ɛ"), (r"e(?=[lłmnŋɲrɾ]\.?(?:[^aeıioöuüạɑɛ.]|$))", "æ"),
    ("i$", "ɪ"), ("ı", "ɯ"), ("ö", "œ"), ("u$", "ʊ"), ("ü$", "Y"), ("ü", "y"),
)
SOUND_VOWELS = "ạɑeɛæiɪɯœọYyuʊụo"


def small_letters(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def syllables(word: Column) -> Column:
    """The word in small letters with a dot between syllables: between vowels, and before a
    consonant that a vowel follows."""
    out = F.regexp_replace(small_letters(word), f"([{VOWEL}])(?=[{VOWEL}])", "$1.")
    return F.regexp_replace(out, f"([{VOWEL}][{CONSONANT}]*?)(?=[{CONSONANT}][{VOWEL}])", "$1.")


def sounds(word: Column) -> Column:
    """A word's sounds, its last vowel stressed."""
    out = syllables(word)
    for pattern, sound in SOUNDS:
        out = F.regexp_replace(out, pattern, sound)
    return F.replace(F.regexp_replace(out, f"([{SOUND_VOWELS}])(?=[^{SOUND_VOWELS}]*$)", "ˈ$1"), F.lit("."), F.lit(""))


def capitals(text: Column) -> Column:
    return F.upper(F.replace(text, F.lit("i"), F.lit("İ")))


def spellings(word: Column) -> dict[str, Column]:
    """Other spellings in which a word may stand: its first letter or all letters capital, without
    circumflexes, and in ASCII letters."""
    first = F.concat(capitals(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))
    return {"first": first, "whole": capitals(word), "plain": F.translate(word, "âîûÂÎÛ", "aiuAİU"), "ascii": ascii_fold(word)}


def case_variants(word: Column) -> Column:
    """The word and its other spellings, each once."""
    return F.array_distinct(F.array(word, *spellings(word).values()))


#: What ends a sentence, what opens, and what closes.
OPENING = ("(", "[", "{", "“", "‘", "‹", "«", "'", '"', "''")
SENTENCE_ENDS = ("...", "…", ".", "?", "!")
CLOSING = (")", "]", "}", "”", "’", "›", "»", '"', "''")
_SIGN = r"\s(\[{“‘‹«'\"”›»,;:)\]}.?!…\-+<>*/"
TOKEN = rf"\.\.\.|''|[0-9]+(?:[.,][0-9]+)*|[^{_SIGN}](?:\.(?=\s|$))|[^{_SIGN}]+(?:[.\-'’][^{_SIGN}]+)*|[^\s]"
#: The same without looking ahead: a letter's dot is a token of its own.
PLAIN_TOKEN = rf"\.\.\.|''|[0-9]+(?:[.,][0-9]+)*|[^{_SIGN}]+(?:[.\-'’][^{_SIGN}]+)*|[^\s]"


def sentence_tokens(text: Column, initials: bool = True) -> Column:
    """Words, numbers and signs; dots, hyphens and apostrophes inside words and numbers stay, and
    with ``initials`` the dot of a single letter."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN if initials else PLAIN_TOKEN})"), F.lit(1))


def sentences(tokens: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Tokens by sentence. A sentence ends with a mark that ends one, but not where the mark follows
    an abbreviation or a number, or stands before what closes, once something has opened."""

    def ends(t: Column) -> Column:
        at = lambda i: F.get(t, i)
        before = lambda i: F.when(i > 0, at(F.greatest(i - 1, F.lit(0))))
        spared = lambda i: F.coalesce(before(i).rlike("^[0-9]+$") | (before(i).isin(*abbreviations) if abbreviations else F.lit(False)), F.lit(False))
        opened = F.coalesce(F.array_position(F.transform(t, lambda x: x.isin(*OPENING)), F.lit(True)), F.lit(0))
        closes = lambda i, first: F.coalesce(at(i + 1).isin(*CLOSING), F.lit(False)) & (first > 0) & (first <= i)
        goes_on = lambda i: F.coalesce(at(i + 1).isin(*SENTENCE_ENDS), F.lit(False))
        found = lambda first: F.transform(t, lambda x, i: F.when(x.isin(*SENTENCE_ENDS) & ~spared(i) & ~closes(i, first) & ~goes_on(i), i))
        return F.filter(let(opened, found), lambda i: i.isNotNull())

    def cut(t: Column, e: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(e)), lambda k: F.slice(t, F.when(k == 0, 1).otherwise(F.get(e, F.greatest(k - 1, F.lit(0))) + 2), F.coalesce(F.get(e, k), F.size(t) - 1) - F.when(k == 0, F.lit(-1)).otherwise(F.get(e, F.greatest(k - 1, F.lit(0))))))
        return F.filter(made, lambda s: F.size(s) > 0)

    return let(tokens, lambda t: let(ends(t), lambda e: cut(t, e)))


#: Number words.
UNITS = ("sıfır", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz")
TENS = ("on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")
HUNDRED = "yüz"
POWERS = ("bin", "milyon", "milyar", "trilyon")


def number_value(words: Column) -> Column:
    """The number that a list of number words spells, or null if any is none."""
    values = {w: (i, 0) for i, w in enumerate(UNITS)} | {w: (10 * (i + 1), 0) for i, w in enumerate(TENS)} | {HUNDRED: (100, 1)} | {w: (1000 ** (i + 1), 2) for i, w in enumerate(POWERS)}
    table = F.create_map(*(x for w, (v, k) in values.items() for x in (F.lit(w), F.struct(F.lit(v).cast("long").alias("v"), F.lit(k).alias("k")))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"))

    def step(s: Column, w: Column) -> Column:
        e = F.try_element_at(table, w)
        group = F.when(e["k"] == 0, s["group"] + e["v"]).when(e["k"] == 1, s["group"] - F.pmod(s["group"], F.lit(10)) + F.greatest(F.pmod(s["group"], F.lit(10)), F.lit(1)) * 100).when(e["k"] == 2, F.lit(0)).cast("long")
        total = F.when(e["k"] == 2, s["total"] + F.greatest(s["group"], F.lit(1)) * e["v"]).when(e["k"].isNotNull(), s["total"])
        return F.struct(total.cast("long").alias("total"), group.alias("group"))

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda s: s["total"] + s["group"]))


def spelled_number(n: Column) -> Column:
    """Number words of a number from 0 to 999,999,999,999,999, as a list."""
    units, tens = F.array(*(F.lit(w) for w in UNITS)), F.array(*(F.lit(w) for w in TENS))
    empty = F.array().cast("array<string>")

    def below_thousand(x: Column) -> Column:
        h, t, u = F.floor(x / 100).cast("int"), (F.floor(x / 10) % 10).cast("int"), (x % 10).cast("int")
        hundreds = F.when(h == 0, empty).when(h == 1, F.array(F.lit(HUNDRED))).otherwise(F.array(F.get(units, h), F.lit(HUNDRED)))
        return F.concat(hundreds, F.when(t == 0, empty).otherwise(F.array(F.get(tens, F.greatest(t - 1, F.lit(0))))), F.when(u == 0, empty).otherwise(F.array(F.get(units, u))))

    parts = []
    for i, name in reversed([*enumerate(("", *POWERS))]):
        group = (F.floor(n / 1000**i) % 1000).cast("int")
        alone = F.array(F.lit(name)) if i == 1 else F.array(F.lit(UNITS[1]), F.lit(name))
        parts.append(below_thousand(group) if not i else F.when(group == 0, empty).when(group == 1, alone).otherwise(F.concat(below_thousand(group), F.array(F.lit(name)))))
    return F.when(n == 0, F.array(F.lit(UNITS[0]))).otherwise(F.concat(*parts))


# -- sentences by a transition table --------------------------------------------------------------

#: Classes of tokens: a word, what spares a mark after it (an abbreviation or a number), a mark that ends
#: sentences, what opens, what closes, and quotes that do both.
WORD_CLASS, SPARING, END_MARK, OPENS, CLOSES, QUOTE = range(6)
#: States are bits: something has opened, the last token spares a mark, a sentence may have ended.
OPENED, SPARED, ENDED = 1, 2, 4
#: Ends of sentences in an inner list, so that long texts do not copy one long list for each.
PIECE = 256


def _transitions() -> list[int]:
    """For state * 6 + class: the next state, plus 8 where a sentence begins with this token. An end
    counts once the next token is seen: marks go on with the sentence, and so does what closes, once
    something has opened."""
    table = []
    for state in range(8):
        for kind in range(6):
            goes_on = kind == END_MARK or kind in (CLOSES, QUOTE) and state & OPENED
            begins = 8 if state & ENDED and not goes_on else 0
            opened = OPENED if state & OPENED or kind in (OPENS, QUOTE) else 0
            ended = ENDED if kind == END_MARK and not state & SPARED else 0
            table.append(opened | (SPARED if kind == SPARING else 0) | ended | begins)
    return table


def token_classes(tokens: Column, abbreviations: Column) -> Column:
    """The class of each token of a list, with its place: place * 8 + class. What is longer than any
    mark is only asked whether it spares one. abbreviations: a list of lower-cased words."""
    quotes = [x for x in OPENING if x in CLOSING]
    longest = max(map(len, (*OPENING, *CLOSING, *SENTENCE_ENDS)))
    following = lambda i: F.coalesce(F.get(tokens, i + 1).isin(*SENTENCE_ENDS), F.lit(False))
    word = lambda x, i: F.when(following(i) & (x.rlike("^[0-9]+$") | F.array_contains(abbreviations, F.lower(x))), SPARING).otherwise(WORD_CLASS)
    one = lambda x, i: (
        F.when(F.length(x) > longest, word(x, i))
        .when(x.isin(*SENTENCE_ENDS), END_MARK)
        .when(x.isin(*quotes), QUOTE)
        .when(x.isin(*OPENING), OPENS)
        .when(x.isin(*CLOSING), CLOSES)
        .otherwise(word(x, i))
    )
    return F.transform(tokens, lambda x, i: i * 8 + one(x, i))


def sentence_starts(tokens: Column, abbreviations: Column | None = None) -> Column:
    """Places, from 0, of the tokens that begin a sentence: the transition table folded over a text's
    tokens in one pass. A sentence ends with a mark that ends one, but not where the mark follows an
    abbreviation or a number, goes on in further marks, or stands before what closes, once something
    has opened; what opened stays open to the end of the text. A word changes nothing where neither an
    end nor a spared mark is at hand, and leaves the state as it is."""
    known = F.array().cast("array<string>") if abbreviations is None else abbreviations
    table = F.array(*map(F.lit, _transitions()))
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<array<int>>").alias("whole"), empty.alias("piece"))

    def step(a: Column, code: Column) -> Column:
        found = F.get(table, a["state"] * 6 + code % 8)
        place, begins = F.shiftright(code, 3), (found >= 8) | (code < 8)
        full = begins & (F.size(a["piece"]) >= PIECE)
        piece = F.when(full, F.array(place)).when(begins, F.array_append(a["piece"], place)).otherwise(a["piece"])
        whole = F.when(full, F.array_append(a["whole"], a["piece"])).otherwise(a["whole"])
        moved = F.struct(found.bitwiseAND(F.lit(7)).alias("state"), whole.alias("whole"), piece.alias("piece"))
        return F.when((code % 8 == WORD_CLASS) & (a["state"] < SPARED) & (code >= 8), a).otherwise(moved)

    return let(tokens, lambda t: F.aggregate(token_classes(t, known), start, step, lambda a: F.concat(F.flatten(a["whole"]), a["piece"])))


def variant_key(word: Column) -> Column:
    """What all spellings of a word have in common, whether in capitals or not, with or without
    circumflexes, in its own letters or in ASCII: small letters by Turkish rules, then ASCII."""
    return F.translate(F.lower(F.translate(word, CAPITALS, SMALL)), "âîûçğıöşü", "aiucgiosu")
