"""Translation metrics as (row statistics, combination) pairs of columns: mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = 4


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


def numbered(grams: Column) -> Column:
    """Each element with how often it came before, so that a set intersection clips counts. Where
    elements repeat, runs of the sorted ones are numbered, in time linear in them but for the sort."""

    def of_sorted(ordered: Column) -> Column:
        starts = F.filter(F.transform(ordered, lambda g, i: F.when((i == 0) | (g != F.get(ordered, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
        run = lambda heads: lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(heads, k + 1), F.size(ordered)) - 1), lambda j: F.concat(F.get(ordered, s), F.lit("\u0002"), (j - s).cast("string")))
        return let(starts, lambda heads: F.flatten(F.transform(heads, run(heads))))

    first = lambda g: F.transform(g, lambda x: F.concat(x, F.lit("\u00020")))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), first(g)).otherwise(let(F.sort_array(g), of_sorted)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def bleu_stats(hyp: Column, ref: Column, orders: int = ORDERS, least: int = 1) -> Column:
    """struct<m array, t array, hyp, ref>: clipped matches, totals (``least`` where a row is too
    short) and lengths of a row."""
    m = F.array(*(overlap(ngrams(hyp, n), ngrams(ref, n)).cast("long") for n in range(1, orders + 1)))
    t = F.array(*(F.greatest(F.size(hyp) - (n - 1), F.lit(least)).cast("long") for n in range(1, orders + 1)))
    return F.struct(m.alias("m"), t.alias("t"), F.size(hyp).cast("long").alias("hyp"), F.size(ref).cast("long").alias("ref"))


def summed(stats: str, orders: int = ORDERS) -> list[Column]:
    """Aggregates m1.., t1.., hyp, ref of a column of row statistics."""
    own = lambda f, n: F.sum(F.col(f"{stats}.{f}")[n - 1])
    return [own(f, n).alias(f"{f}{n}") for f in "mt" for n in range(1, orders + 1)] + [F.sum(f"{stats}.hyp").alias("hyp"), F.sum(f"{stats}.ref").alias("ref")]


def _brevity(hyp: Column, ref: Column) -> Column:
    return F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - F.try_divide(ref, hyp)))


def bleu_method1(m: list[Column], t: list[Column], hyp: Column, ref: Column) -> Column:
    """BLEU with 0.1 in place of a zero numerator; 0 if no word matches. Between 0 and 1."""
    logs = [F.ln(F.when(a == 0, F.lit(0.1)).otherwise(a.cast("double")) / b) for a, b in zip(m, t, strict=True)]
    mean = sum(logs[1:], logs[0]) / len(logs)
    return F.when((m[0] == 0) | (hyp == 0), F.lit(0.0)).otherwise(_brevity(hyp, ref) * F.exp(mean))


def bleu_exponential(m: list[Column], t: list[Column], hyp: Column, ref: Column) -> Column:
    """BLEU in which the k-th zero precision counts 1 / (2^k total); 0 to 100."""
    zeros, logs = F.lit(0), []
    for a, b in zip(m, t, strict=True):
        zeros = zeros + F.when(a == 0, 1).otherwise(0)
        logs.append(F.ln(F.when(a == 0, 1 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(a / b)))
    return F.when((m[0] == 0) | (hyp == 0), F.lit(0.0)).otherwise(100 * _brevity(hyp, ref) * F.exp(sum(logs[1:], logs[0]) / len(logs)))


def bleu_international(m: list[Column], t: list[Column], hyp: Column, ref: Column, effective: bool = False) -> Column:
    """BLEU as international scoring has it, 0 to 100: the k-th zero precision counts 1 / (2^k
    total); orders that the text is too short for make it 0, or with ``effective`` do not count. Totals
    are those of ``bleu_stats`` with least 0."""
    zeros, logs = F.lit(0), []
    for a, b in zip(m, t, strict=True):
        zeros = zeros + F.when((a == 0) & (b > 0), 1).otherwise(0)
        logs.append(F.when(b == 0, 0.0).when(a == 0, -F.ln(F.pow(F.lit(2.0), zeros) * b)).otherwise(F.ln(a / F.greatest(b, F.lit(1)))))
    live = sum((F.when(b > 0, 1).otherwise(0) for b in t[1:]), F.when(t[0] > 0, 1).otherwise(0))
    score = 100 * _brevity(hyp, ref) * F.exp(sum(logs[1:], logs[0]) / F.greatest(live, F.lit(1)))
    return F.when((sum(m[1:], m[0]) == 0) | (hyp == 0) | (F.lit(not effective) & (live < len(t))), 0.0).otherwise(score)


def bleu_effective(m: list[Column], t: list[Column], hyp: Column, ref: Column) -> Column:
    """The same for a sentence: only orders that it is long enough for count."""
    return bleu_international(m, t, hyp, ref, effective=True)


def precisions(orders: int = ORDERS) -> list[Column]:
    """Percentages p1.. and bp of columns that ``summed`` made."""
    each = [F.coalesce(F.try_divide(100.0 * F.col(f"m{n}"), F.col(f"t{n}")), F.lit(0.0)).alias(f"p{n}") for n in range(1, orders + 1)]
    return [*each, _brevity(F.col("hyp"), F.col("ref")).alias("bp")]


def sentence_bleu(stats: Column, how=bleu_method1, orders: int = ORDERS) -> Column:
    each = lambda f: [stats[f][n] for n in range(orders)]
    return how(each("m"), each("t"), stats["hyp"], stats["ref"])


def combined_bleu(how=bleu_method1, orders: int = ORDERS) -> Column:
    """BLEU of columns that ``summed`` made."""
    return how([F.col(f"m{n}") for n in range(1, orders + 1)], [F.col(f"t{n}") for n in range(1, orders + 1)], F.col("hyp"), F.col("ref"))


def thirteen_a(text: Column) -> Column:
    """Tokens by the usual rules for international scoring: punctuation apart but inside numbers."""
    rules = [(r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"), (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")]
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for p, r in rules:
        out = F.regexp_replace(out, p, r)
    return F.filter(F.split(F.trim(out), r"\s+"), lambda t: t != "")


def chrf(hyp: Column, ref: Column, chars: int = 6, words: int = 2, beta: float = 2.0) -> Column:
    """chrF++ of two texts, 0 to 100."""
    letters = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda x: x != "")
    apart = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"(\p{Punct})", " $1 ")), r"\s+"), lambda x: x != "")

    def order(a: Column, b: Column) -> Column:
        made = F.struct(a.alias("h"), b.alias("r"))
        return let(made, lambda g: F.struct(overlap(g["h"], g["r"]).cast("double").alias("m"), F.size(g["h"]).cast("double").alias("h"), F.size(g["r"]).cast("double").alias("r")))

    units = F.struct(letters(hyp).alias("ch"), letters(ref).alias("cr"), apart(hyp).alias("wh"), apart(ref).alias("wr"))
    rows = let(units, lambda u: F.array(*(order(ngrams(u["ch"], n), ngrams(u["cr"], n)) for n in range(1, chars + 1)), *(order(ngrams(u["wh"], n), ngrams(u["wr"], n)) for n in range(1, words + 1))))
    mean = lambda live, f: F.aggregate(F.transform(live, lambda x: x["m"] / x[f]), F.lit(0.0), lambda s, x: s + x) / F.size(live)
    score = lambda z: F.coalesce(F.try_divide(100 * (1 + beta**2) * z["p"] * z["r"], beta**2 * z["p"] + z["r"]), F.lit(0.0))
    final = lambda live: F.when(F.size(live) == 0, F.lit(0.0)).otherwise(let(F.struct(mean(live, "h").alias("p"), mean(live, "r").alias("r")), score))
    return let(F.filter(rows, lambda x: (x["h"] > 0) & (x["r"] > 0)), final)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def set_recall(hyp: Column, ref: Column) -> Column:
    """Share of the reference's distinct elements that the hypothesis has."""
    h, r = F.array_distinct(hyp), F.array_distinct(ref)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, F.lit(1.0)).otherwise(0.0)).otherwise(F.size(F.array_intersect(h, r)) / F.size(r))


def map_agreement(hyp: Column, ref: Column) -> Column:
    """Share of a reference map's entries that the hypothesis has with the same value."""
    same = F.size(F.filter(F.map_keys(ref), lambda k: F.try_element_at(hyp, k).eqNullSafe(F.try_element_at(ref, k)) & F.try_element_at(hyp, k).isNotNull()))
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, F.lit(1.0)).otherwise(0.0)).otherwise(same / F.size(ref))


def adjacent(labels: Column, words: Column, first: str, second: str) -> Column:
    """Distinct pairs <a, b> of each word labelled ``first`` with the next one labelled ``second``."""
    marked = F.filter(F.zip_with(words, labels, lambda w, t: F.struct(w.alias("w"), t.alias("t"))), lambda x: x["t"].isin(first, second))
    pairs = F.transform(marked, lambda x, i: F.when((x["t"] == first) & (F.get(marked, i + 1)["t"] == second), F.concat_ws("\u0001", x["w"], F.get(marked, i + 1)["w"])))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def labelled(labels: Column, words: Column, wanted: str) -> Column:
    """Distinct words with a label; without labels, all distinct words."""
    chosen = F.transform(F.filter(F.zip_with(words, labels, lambda w, t: F.struct(w.alias("w"), t.alias("t"))), lambda x: x["t"] == wanted), lambda x: x["w"])
    return F.array_distinct(F.when(labels.isNull(), words).otherwise(chosen))


def non_repetition(tokens: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), F.size(tokens)), F.lit(0.0))
