"""Column builders for model output, logs and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known abbreviations, signs of a correction that is none, and alignment sentinels.
ABBREVIATIONS = ("akp", "chp", "mhp", "hdp", "nato", "ab", "eu", "afp", "reuters")
PLACEHOLDERS = ("correct_english_lemma", "actual_correct_translation")
EXPLAINING = ("this is", "the correct", "should be", "translation", "meaning")
SYMBOLS = "!@#$%^&*()_+-=[]{}|;':\",./<>?"
SENTINELS = ("[ - the", "instruction:", "you are", "###", "source sentence", "target sentence")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(text, F.lit(n))
    return out


def first_translation(text: Column) -> Column:
    """The first non-empty of the first two lines of the first tagged translation, without tags;
    the text itself if none is tagged."""
    closed, opened = r"(?s)<translation>(.*?)</translation>", r"(?s)<translation>(.*?)<translation>"
    found = F.when(text.rlike(closed), F.regexp_extract(text, closed, 1)).when(text.rlike(opened), F.regexp_extract(text, opened, 1))
    lines = F.split(F.regexp_replace(found, r"^\s+|\s+$", ""), "\n")
    line = F.coalesce(F.nullif(F.trim(F.get(lines, F.lit(0))), F.lit("")), F.trim(F.get(lines, F.lit(1))), F.lit(""))
    return F.when(found.isNull(), text).otherwise(F.regexp_replace(line, "<[^>]*>", ""))


def clean_generated(text: Column) -> Column:
    pattern = r"(?s)<translation>(.*?)</translation>"
    bare = F.replace(F.replace(text, F.lit("<translation>"), F.lit("")), F.lit("</translation>"), F.lit(""))
    return F.trim(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(bare))


def verdict(response: Column) -> Column:
    low = F.lower(F.trim(response))
    tagged = F.upper(F.regexp_extract(response, r"(?i)<VERDICT>(CORRECT|INCORRECT)</VERDICT>", 1))
    wrong = F.contains(low, F.lit("incorrect"))
    right = F.contains(F.replace(low, F.lit("incorrect"), F.lit("")), F.lit("correct"))
    return F.when(tagged != "", tagged).when(F.startswith(low, F.lit("correct")), "CORRECT").when(F.startswith(low, F.lit("incorrect")), "INCORRECT").when(right & ~wrong, "CORRECT").otherwise("UNCLEAR")


def correction(response: Column) -> Column:
    """The correction, or what is left of an untagged response; implausible ones are empty."""
    said = verdict(response)
    tagged = F.trim(F.regexp_extract(response, r"(?is)<CORRECTION>(.*?)</CORRECTION>", 1))
    rest = F.trim(F.regexp_replace(F.trim(response), r"(?i)<VERDICT>INCORRECT</VERDICT>", ""))
    found = F.when((tagged == "") & (said == "INCORRECT") & (rest != "") & ~F.startswith(rest, F.lit("<")), rest).otherwise(tagged)
    low = F.lower(found)
    suspect = _any(low, PLACEHOLDERS) | (F.length(found) > 50) | _any(low, EXPLAINING)
    return F.when((said == "INCORRECT") & suspect, "").otherwise(found)


def validated(source: Column, target: Column, said: Column, fix: Column) -> tuple[Column, Column]:
    """Verdict and correction after the rules on identity, numbers, symbols, abbreviations and
    proper names, of which later ones overrule earlier ones."""
    digits = lambda c: c.rlike(r"^\p{Nd}+$")
    letters = lambda c: c.rlike(r"^\p{L}+$")
    low_s, low_t = F.lower(source), F.lower(target)
    same = (source == target) & (said != "CORRECT")
    said, fix = F.when(same, "CORRECT").otherwise(said), F.when(same, "").otherwise(fix)
    fix = F.when(digits(source) & (fix != "") & ~digits(fix), source).otherwise(fix)
    symbol = (F.length(source) == 1) & F.contains(F.lit(SYMBOLS), source) & (target != source)
    short = low_s.isin(*ABBREVIATIONS) & (low_t != low_s) & ((F.length(target) > 10) | ~letters(target))
    first = F.left(source, F.lit(1))
    upper = (first == F.upper(first)) & (first != F.lower(first))
    shares = F.exists(F.split(F.left(low_s, F.lit(3)), ""), lambda c: (c != "") & F.contains(low_t, c))
    name = upper & letters(source) & (F.length(source) > 2) & (low_t != low_s) & ~shares
    wrong = symbol | short | name
    return F.when(wrong, "INCORRECT").otherwise(said), F.when(short | name, low_s).when(symbol, source).otherwise(fix)


def log_metrics(line: Column) -> dict[str, Column]:
    """Metrics of a training log's line; null where it has none."""
    number = lambda p: F.regexp_extract(line, p, 1).try_cast("double")
    return {
        "step": F.regexp_extract(line, r"Step (\d+)", 1).try_cast("long"),
        "epoch": F.regexp_extract(line, r"Epoch (\d+)", 1).try_cast("long"),
        "train_loss": number(r"Train .*?loss: ([\d.]+)"),
        "valid_loss": number(r"Validation .*?loss: ([\d.]+)"),
        "learning_rate": number(r"lr: ([\d.e\-]+)"),
        "accuracy": number(r"accuracy: ([\d.]+)"),
        "perplexity": number(r"ppl: ([\d.]+)"),
        "checkpoint": F.nullif(F.regexp_extract(line, r"Saving checkpoint (.*?) to", 1), F.lit("")),
    }


def alignment_pairs(block: Column) -> Column:
    """Pairs of an answer's ``source - target`` lines up to the first sentinel line."""
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
    stop = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("[")) | _any(F.lower(x), SENTINELS)), F.lit(True))
    kept = F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    pairs = F.transform(kept, lambda x: F.split(x, " - "))
    sound = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(F.get(p, F.lit(0))) != "") & (F.trim(F.get(p, F.lit(1))) != ""))
    return F.transform(sound, lambda p: F.struct(F.trim(p[0]).alias("source"), F.trim(p[1]).alias("target")))


def tagged_block(text: Column, tag: str = "alignments") -> Column:
    """What stands between a tag and its end, or after the tag, or else the whole text."""
    opened, closed = f"<{tag}>", f"</{tag}>"
    inner = F.regexp_extract(text, rf"(?s){opened}(.*?){closed}", 1)
    rest = F.substr(text, F.locate(opened, text) + len(opened))
    return F.trim(F.when(F.contains(text, F.lit(opened)) & text.rlike(rf"(?s){opened}.*?{closed}"), inner).when(F.contains(text, F.lit(opened)), rest).otherwise(text))


def tagged_alignments(text: Column) -> Column:
    """Pairs <source, target> of the ``source - target`` lines of a tagged block."""
    parts = lambda x: F.struct(F.trim(F.substring_index(x, " - ", 1)).alias("source"), F.trim(F.substr(x, F.locate(" - ", x) + 3)).alias("target"))
    lines = F.filter(F.transform(F.split(tagged_block(text), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(" - ")))
    return F.filter(F.transform(lines, parts), lambda p: (p["source"] != "") & (p["target"] != ""))


def alignment_flags(text: Column, tag: str = "alignments") -> dict[str, Column]:
    """Whether an answer has its tags, how many alignments, and whether its form is sound."""
    begin, end = F.contains(text, F.lit(f"<{tag}>")), F.contains(text, F.lit(f"</{tag}>"))
    n = F.size(tagged_alignments(text)).cast("long")
    return {"has_start_tag": begin, "has_end_tag": end, "has_alignment_tags": begin & end, "num_alignments": n, "is_valid_format": begin & end & (n > 0)}


def nested(document: Column, path: str, default: str = "") -> Column:
    """A field of a JSON document by its path, or a default."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


#: How surfaces begin, what analyses begin with, and what is put for what.
SURFACE_REWRITES = (
    (("kendisi",), "kendi<", "kendi", "kendisi"),
    (("kendileri",), "kendi<", "kendi<Prn:refl:3p><p3p>", "kendileri<Prn:refl:3p>"),
    (("Prof",), "profesör<", "profesör<N>", "Prof<N:abbr>"),
    (("Doç",), "doçent<", "doçent<N>", "Doç<N:abbr>"),
    (("Dr",), "doktor<", "doktor<N>", "Dr<N:abbr>"),
    (("Org",), "orgeneral<", "orgeneral<N>", "Org<N:abbr>"),
    (("Tıp", "tıp"), "tıb<", "tıb", "tıp"),
)


def surface_rewritten(surface: Column, analysis: Column) -> Column:
    """The analysis after the first of the rewrites that surface and analysis call for, at its first
    place."""
    out = None
    for begins, lead, old, new in SURFACE_REWRITES:
        met = F.startswith(surface, F.lit(begins[0]))
        for b in begins[1:]:
            met = met | F.startswith(surface, F.lit(b))
        at = F.locate(old, analysis)
        made = F.when(at == 0, analysis).otherwise(F.concat(F.left(analysis, F.greatest(at - 1, F.lit(0))), F.lit(new), F.substr(analysis, at + len(old))))
        case = met & F.startswith(analysis, F.lit(lead))
        out = F.when(case, made) if out is None else out.when(case, made)
    return out.otherwise(analysis)


def message_of(messages: Column, role: str) -> Column:
    """The content of the first message of a role."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def serialised(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def masked_labels(ids: Column, prompt_length: Column, size: int, ignore: int = -100) -> Column:
    """Label ids of a fixed length: the prompt's and the padding are ignored."""
    own = F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(ignore)).otherwise(x))
    return F.slice(F.concat(own, F.array_repeat(F.lit(ignore), size)), 1, size)


def slug(prompt: Column) -> Column:
    """A file name of the first three words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(prompt), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(words, 1, 3), "_")


def filled(template: str, **values: Column) -> Column:
    """A template with its {name} places filled in."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def example_section(examples: Column, template: str = "Example {n}:\nInput: {input}\nOutput: {output}") -> Column:
    one = lambda e, i: filled(template, n=(i + 1).cast("string"), input=e["input"], output=e["output"])
    return F.array_join(F.transform(examples, one), "\n\n")
