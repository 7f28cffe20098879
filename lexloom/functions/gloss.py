"""Column builders for gloss tokens ``base-TAG1-TAG2`` and analyses ``lemma<Pos:sub><tag>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import PUNCTUATION, tokens

#: Analysis tags and the gloss tags that they become.
TAG_MAP = {
    "N": "NOM", "N:prop": "PROP", "Adj": "ADJ", "Adv": "ADV", "V": "V", "Prn": "PRN", "Det": "DET", "Num": "NUM", "Postp": "POSTP", "Cnj": "CNJ",
    "nom": "NOM", "acc": "ACC", "dat": "DAT", "gen": "GEN", "loc": "LOC", "abl": "ABL", "ins": "INS",
    "past": "PST", "pres": "PRES", "fut": "FUT", "aor": "AOR", "prog": "PROG", "evid": "EVID", "cond": "COND", "opt": "OPT", "imp": "IMP",
    "pass": "PASS", "caus": "CAUS", "abil": "ABIL", "neg": "NEG",
    "p1s": "1SG", "p2s": "2SG", "p3s": "3SG", "p1p": "1PL", "p2p": "2PL", "p3p": "3PL",
    "pl": "PL", "Q": "Q", "rfl": "REFL", "dir": "DIR", "part": "PART", "vn": "VN",
}
#: Part-of-speech tags, tags by priority, merged prefixes, dropped and ignored tags.
POS_TAGS = ("NOM", "V", "ADJ", "ADV", "CNJ", "PROP", "DET", "PRN", "POSTP", "NUM")
PRIORITIES = (
    POS_TAGS,
    ("PL", "3SG", "1PL", "2PL", "3PL", "1SG", "2SG", "3S", "1S", "2S", "1P", "2P", "3P", "PST", "FUT", "PROG", "NEG", "PASS", "CAUS", "ABIL", "AOR", "EVID"),
    ("GEN", "DAT", "ACC", "LOC", "ABL", "INS"),
    ("VN", "PART", "CV", "CPL", "LIK", "LI", "DIR", "OPT", "IMP"),
)
MERGED = ("PART", "CV", "CPL", "VN")
DROPPED = (
    "COND", "REFL", "IMPF", "POSTP:ADV:NOMC", "MREDUP", "ALPHA", "RCP", "CV:INCE", "SYM", "ROM", "CV:DIKCE", "DIST", "SI", "DIM", "TYPO",
    "ISE", "CNJ:ADV", "CV:YE", "IK", "ACCC", "CPL:EVID",
)
IGNORED = ("", "PUNC")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def base(token: Column) -> Column:
    return F.substring_index(token, "-", 1)


def tags(token: Column) -> Column:
    parts = F.split(token, "-")
    return F.slice(parts, F.lit(2), F.size(parts))


def render(word: Column, tag_list: Column) -> Column:
    return F.array_join(F.concat(F.array(word), tag_list), "-")


def retag(tag: Column, mapping: dict[str, str] | None = None) -> Column:
    """The mapped tag, or the tag in capitals."""
    return F.coalesce(F.try_element_at(_map(TAG_MAP if mapping is None else mapping), tag), F.upper(tag))


def convert_analysis(analysis: Column, mapping: dict[str, str] | None = None) -> Column:
    """``lemma<Pos:sub><tag>`` as ``lemma-POS-SUB-TAG``; unanalysed words as they were."""
    lead = F.get(F.split(F.trim(analysis), r"\s+"), F.lit(0))
    word = F.when(analysis.rlike(r"^\S+\s+\S"), lead).otherwise(F.substring_index(analysis, "<", 1))
    inner = F.regexp_extract_all(analysis, F.lit("<([^>]*)>"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda t, i: F.when(i == 0, F.split(t, ":")).otherwise(F.array(t))))
    made = F.concat_ws("-", word, F.array_join(F.transform(parts, lambda t: retag(t, mapping)), "-"))
    return F.when(F.contains(analysis, F.lit("???")), lead).when(~F.contains(analysis, F.lit("<")), analysis).otherwise(made)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def simplify_tag(tag: Column) -> Column:
    """Prefixes merge first; then listed tags drop to null; the rest stay."""
    out = F.when(F.startswith(tag, F.lit(f"{MERGED[0]}:")), MERGED[0])
    for m in MERGED[1:]:
        out = out.when(F.startswith(tag, F.lit(f"{m}:")), m)
    return out.when(tag.isin(*DROPPED), F.lit(None).cast("string")).otherwise(tag)


def simplify_token(token: Column) -> Column:
    return render(base(token), F.filter(F.transform(tags(token), simplify_tag), lambda t: t.isNotNull()))


def priority(tag: Column) -> Column:
    out = F.when(tag.isin(*PRIORITIES[0]), 1)
    for k, names in enumerate(PRIORITIES[1:], 2):
        out = out.when(tag.isin(*names), k)
    return out.otherwise(len(PRIORITIES) + 1)


def top_tags(tag_list: Column, most: int = 2) -> Column:
    """Over the limit, the tags of best priority in that order; else all as they are."""
    kept = F.filter(tag_list, lambda t: ~t.isin(*IGNORED))
    ranked = F.sort_array(F.transform(kept, lambda t, i: F.struct(priority(t).alias("p"), i.alias("i"), t.alias("t"))))
    return F.when(F.size(tag_list) <= most, tag_list).otherwise(F.transform(F.slice(ranked, 1, most), lambda z: z["t"]))


def dropped_tags(tag_list: Column, most: int = 2) -> Column:
    """The tags that ``top_tags`` drops for their priority."""
    kept = F.filter(tag_list, lambda t: ~t.isin(*IGNORED))
    ranked = F.sort_array(F.transform(kept, lambda t, i: F.struct(priority(t).alias("p"), i.alias("i"), t.alias("t"))))
    over = (F.size(tag_list) > most) & (F.size(ranked) > most)
    return F.when(over, F.transform(F.slice(ranked, F.lit(most + 1), F.greatest(F.size(ranked) - most, F.lit(1))), lambda z: z["t"])).otherwise(F.array().cast("array<string>"))


def without_pos(tag_list: Column, every: bool = False) -> Column:
    """Tags without the first part-of-speech tag, or without all of them."""
    first = F.array_position(F.transform(tag_list, lambda t: t.isin(*POS_TAGS)), F.lit(True)) - 1
    return F.filter(tag_list, lambda t, i: ~(t.isin(*POS_TAGS) & (F.lit(every) | (i == first))))


def per_token(line: Column, change, has_code: bool = True) -> Column:
    """A gloss line with every token changed but a leading language code."""
    return F.array_join(F.transform(tokens(line), lambda t, i: F.when((i == 0) & F.lit(has_code), t).otherwise(change(t))), " ")


def clean_line(line: Column) -> Column:
    """Bases without punctuation, in lower case where they held a quote; empty tokens go."""

    def one(t: Column) -> Column:
        word = base(t)
        bare = F.regexp_replace(word, PUNCTUATION, "")
        bare = F.when(word.rlike("['\"]"), F.lower(bare)).otherwise(bare)
        tail = F.substr(t, F.length(word) + 1)
        return F.when(bare == "", "").otherwise(F.concat(bare, tail))

    return F.array_join(F.filter(F.transform(tokens(line), one), lambda t: t != ""), " ")


def lemma_and_tags(analysis: Column) -> tuple[Column, Column]:
    pattern = "^(<|[^<]+)(<.*)"
    return F.regexp_extract(analysis, pattern, 1), F.regexp_extract(analysis, pattern, 2)


def english_lemma(word: Column, known: Column | None = None) -> Column:
    """The known lemma of a word, else the word with plural, past or progressive endings cut."""
    if known is not None:
        return F.coalesce(known, english_lemma(F.lower(word)))
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    return F.when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & (n > 3), cut(1)).when(F.endswith(word, F.lit("ed")) & (n > 4), cut(2)).when(F.endswith(word, F.lit("ing")) & (n > 5), cut(3)).otherwise(word)


def keep_segmentation(word: Column, segmented: Column) -> Column:
    """Whether a segmentation without its hyphens is the word."""
    return F.lower(F.replace(segmented, F.lit("-"), F.lit(""))) == F.lower(word)


def analysis_failed(analyses: Column, plus_mark: bool = True) -> Column:
    """Whether there is no analysis, or any is a failure mark."""
    bad = lambda a: (F.contains(a, F.lit("+?")) & F.lit(plus_mark)) | F.contains(a, F.lit("no result")) | (F.trim(a) == "")
    return (F.size(analyses) == 0) | F.exists(analyses, bad)


def infinitive(stem: Column) -> Column:
    """A verb's stem with -mek or -mak, by the harmony of its last vowel."""
    last = F.regexp_extract(stem, "([aeıioöuüâîû])[^aeıioöuüâîû]*$", 1)
    return F.concat(stem, F.when(last.isin("e", "i", "ö", "ü", "î"), "mek").otherwise("mak"))


def stem_of(analysis: Column, with_pos: bool = False) -> Column:
    """The lemma of an analysis, verbs as infinitives, and its part of speech if asked for."""
    lemma = F.substring_index(analysis, "<", 1)
    pos = F.regexp_extract(analysis, "<([A-Za-z]+)", 1)
    out = F.when(pos == "V", infinitive(lemma)).otherwise(lemma)
    return F.concat(out, F.lit("<"), pos, F.lit(">")) if with_pos else out
