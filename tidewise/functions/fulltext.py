"""English stemming and ranked full-text matching, where words must match in any inflection.

`indexed` gives every row its lexemes once (stem, position, weight by field); stems are looked up for the different words only. A
query's words are stemmed when the plan is made, and `text_rank` matches and ranks by expressions over the lexemes.

Rules are those of the public Porter2 description and of PostgreSQL's documented ts_rank with default weights.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.functions.text import alnum_words

#: Words that an English text search ignores.
ENGLISH_STOP = frozenset([
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
])
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset(["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"])
_KEPT = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", None), ("li", None),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    found = re.match(r"(gener|commun|arsen)", word)
    r1 = found.end() if found else (m.end() if (m := re.search(r"[aeiouy][^aeiouy]", word)) else len(word))
    r2 = m.end() + r1 if (m := re.search(r"[aeiouy][^aeiouy]", word[r1:])) else len(word)
    return r1, r2


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(r"(^y|(?<=[aeiouy])y)", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if to is None:
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Fields and their weights, as in ts_rank's defaults for A, B and C.
WEIGHTS = {"name": 1.0, "description": 0.4, "category": 0.2}
_LEXEMES = "array<struct<pos:int,weight:double,lexeme:string>>"


def query_terms(query: str) -> list[str]:
    """The different stems of a query's words, without ignored ones."""
    return list(dict.fromkeys(stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in ENGLISH_STOP))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def indexed(items: DataFrame, fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """items with `lexemes`, an array of (pos, weight, lexeme) over all fields, in order; each different text is read once.

    Ignored words count for positions. A field's positions follow on the last lexeme of the field before.
    """
    stop = F.array(*map(F.lit, sorted(ENGLISH_STOP)))
    texts = items.select(*fields).distinct()
    last, parts = F.lit(0), []
    for field, weight in fields.items():
        words = F.transform(alnum_words(F.coalesce(F.col(field), F.lit(""))), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word")))
        own = F.filter(words, lambda x: ~F.array_contains(stop, x["word"]))
        shift = last
        parts.append(F.transform(own, lambda x: F.struct((x["pos"] + shift).cast("int").alias("pos"), F.lit(weight).alias("weight"), x["word"].alias("word"))))
        last = shift + F.coalesce(F.array_max(F.transform(own, lambda x: x["pos"])), F.lit(0))
    placed = texts.select(*fields, F.explode(F.concat(*parts)).alias("x")).select(*fields, "x.*")
    stems = placed.select("word").distinct().withColumn("lexeme", F.pandas_udf(_stems, "string")("word"))
    one = F.struct("pos", "weight", "lexeme")
    of_text = placed.join(stems, "word").groupBy(*fields).agg(F.array_sort(F.collect_list(one)).alias("lexemes"))
    same = reduce(lambda a, b: a & b, [F.col(f"i.{f}").eqNullSafe(F.col(f"t.{f}")) for f in fields])
    return items.alias("i").join(of_text.alias("t"), same, "left").select("i.*", F.coalesce("t.lexemes", F.array().cast(_LEXEMES)).alias("lexemes"))


def text_rank(lexemes: Column, query: str) -> Column:
    """ts_rank of all the query's words, to six decimals; null where one is missing or the query has none."""
    terms = query_terms(query)
    if not terms:
        return F.lit(None).cast("double")
    places = {t: _of_term(lexemes, t) for t in terms}
    has_all = reduce(lambda a, b: a & b, [F.size(p) > 0 for p in places.values()])
    if len(terms) == 1:
        weights = F.transform(places[terms[0]], lambda x: x["weight"])
        total = F.aggregate(F.transform(weights, lambda w, k: w / ((k + 1) * (k + 1))), F.lit(0.0), lambda a, b: a + b)
        best = F.array_max(weights)
        first = F.array_position(weights, best)
        rank = (best + total - best / (first * first)) / 1.64493406685
    else:

        def apart(x: Column, y: Column) -> Column:
            """One less what a pair of places adds."""
            d = F.greatest(F.lit(1), F.abs(x["pos"] - y["pos"]))
            near = F.when(d <= 100, 1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))).otherwise(1e-30)
            return 1 - F.sqrt(x["weight"] * y["weight"] * near)

        def missing(a: str, b: str) -> Column:
            return F.aggregate(places[a], F.lit(1.0), lambda m, x: m * F.aggregate(places[b], F.lit(1.0), lambda k, y: k * apart(x, y)))

        rank = 1 - reduce(lambda a, b: a * b, [missing(a, b) for a, b in combinations(terms, 2)])
    return F.when(has_all, F.round(rank, 6))


def _of_term(lexemes: Column, term: str) -> Column:
    return F.filter(lexemes, lambda x: x["lexeme"] == term)
