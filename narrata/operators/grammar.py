"""A grammar of clauses as rule rows, matched inside whole-stage code.

Each token of a sentence becomes one letter that says its word class, so a sentence is a short string and a rule is a
regular expression over letters. Rules are built of other rules by name; matching is one expression per rule, without
joins, shuffles or Python. Rules are data: a family of rows (family, name, rule), in which ``{name}`` stands for another.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of closed classes, by the class's letter.
CLOSED = {
    "d": "the a an this these those every each some any no another both either neither",
    "o": "my your his her its our their",
    "r": "i you he she it we they me him us them himself herself itself themselves",
    "q": "who which whom whose what where how why",
    "s": "that because if when while although though since unless until whether than as",
    "c": "and or but nor yet",
    "t": "to",
    "p": "of in with for on at by from into over under between through about after before against among during without within upon",
    "b": "is are was were am be",
    "e": "been",
    "f": "being",
    "h": "has have had having",
    "x": "do does did",
    "m": "will would can could shall should may might must",
    "g": "get gets got getting make makes made let lets see saw hear heard help helps helped",
    "k": "think thinks thought say says said believe believes believed know knows knew ask asks asked tell tells told",
    "n": "not never",
    "y": "oh yes ah well please hello goodbye",
    "u": "mr mrs miss ms dr sir lady lord professor captain",
    "l": "street avenue road lane square box",
    "w": "inch inches foot feet mile miles pound pounds ounce hour hours minute minutes",
    "z": "one two three four five six seven eight nine ten eleven twelve hundred thousand first second third fourth fifth",
    "D": "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december",
    "C": "called named known nicknamed alias aka",
}
#: Open classes by form, in this order: digits, marks, capitals, adverbs, participles, pasts, adjectives; the rest are nouns.
OPEN = (("Z", "^[0-9]+$"), (",", "^[,;:]$"), ("P", "^\\p{Lu}"), ("a", "ly$"), ("i", "ing$"), ("v", "(ed|en)$"), ("j", "(ful|ous|able|ible|ive|al|ic|less|er|est)$"))
NOUN = "N"
TOKEN = "\\p{L}[\\p{L}']*|[0-9]+|[,;:]"
STOPS = "[.!?\\n]+"
PIECE = ".{1,200}"  # longer runs without a stop are no sentences; they are read in pieces, so that matching stays linear

#: Rules that others are built of.
SHARED = {
    "adj": "(?:a?j(?:c?a?j)*)", "det": "(?:[do]|[zZ])", "np": "(?:{det}?{adj}?[iv]?N+|{det}?P+|{det}N*|r)", "pp": "(?:[pt]{np})", "nps": "(?:{np}(?:,?c{np})*)", "obj": "(?:{nps}{pp}*)",
    "aux": "(?:m?n?(?:he?|b|x)n?a?)", "verb": "(?:m?n?h?n?e?b?f?a?[vigkxbh])", "think": "(?:m?n?h?a?k)", "inf": "(?:ta?[bhxgkN])", "vp": "(?:{verb}a?{obj}?)", "s1": "(?:{nps}{pp}*a?{vp})", "rel": "(?:[qs]{s1}|q{vp})",
}

#: (family, name, rule): the families of phrases and clauses.
RULES = (
    ("nouns", "noun", "{np}"), ("nouns", "possessed", "o{adj}?N+"), ("nouns", "apposed", "{np},{np}"), ("nouns", "joined", "{np}(?:,{np})*,?c{np}"), ("nouns", "related", "{np}{rel}"),
    ("basic", "adverbs", "a(?:c?a)*"), ("basic", "adjectives", "{adj}"), ("basic", "numbers", "[zZ]+(?:c?[zZ])*"), ("basic", "measures", "[zZ]w"), ("basic", "as_as", "s[aj]s"), ("basic", "dates", "(?:pD|D[zZ]?|[zZ]D)[zZ]*"),
    ("bare_infinitives", "bare", "[gx](?:{np})?a?[bhxN]{obj}"), ("think_bare_infinitives", "told", "k{np}a?[bhx]{obj}?"), ("infinitives", "infinitive", "{inf}{obj}?"), ("infinitives", "chained", "{inf}{obj}?(?:,?c{inf}{obj}?)+"),
    ("verbs", "active", "m?n?a?[vg]"), ("verbs", "ongoing", "{aux}f?a?i"), ("verbs", "perfect", "h[na]*e?[vi]"), ("verbs", "passive", "b[na]*f?v"), ("verbs", "conditional", "m[na]*(?:b|h|x|g|k)"), ("verbs", "thought", "{think}"),
    ("secondary", "objects", "{verb}{obj}"), ("secondary", "two_objects", "{verb}{np}{nps}"), ("secondary", "relative", "q{aux}?{vp}"), ("secondary", "participle", ",[iv]{obj}"),
    ("prepositional", "phrase", "{pp}"), ("prepositional", "chain", "{pp}(?:,?c?{pp})+"), ("clause_after_infinitive", "purpose", "{s1}{inf}{obj}?"), ("clause_core", "clause", "{s1}"), ("clause_core", "hailed", "P+,{s1}"),
    ("closings", "closing", "{s1}(?:,?a|,y|,{pp}|,P+)$"), ("clauses", "clause", "{nps}{pp}*a?{verb}a?{obj}?{pp}*"), ("clauses", "inverted", "^(?:b|m|x|h){nps}{vp}"), ("clause_nouns", "that", "s{s1}"), ("clause_nouns", "gerund", "i{obj}"),
    ("clause_verbs", "supposed", "{nps}{think}s?{s1}"), ("clause_verbs", "passive_by", "{nps}b[na]*v{pp}+"), ("clause_verbs", "would_be", "m[na]*(?:b|he|hef?)"), ("main_clauses", "main", "^{s1}"), ("main_clauses", "joined", "{s1},?c{s1}"),
    ("noun_intros", "opening", "^(?:a|{pp}|[zZ]N+),?{nps}"), ("clause_intros", "opening", "^(?:a|c|y|{pp}),?{s1}"), ("clause_intros", "subordinate", "^s{s1},?{s1}"), ("second_clauses", "contrast", "{s1},s{s1}"),
    ("commands", "command", "^(?:y,?)?(?:[gkx]|N){obj}"), ("relatives", "relative", "{np},?{rel}"), ("clause_phrases", "phrase_clause", "{pp},{s1}"), ("tails", "tail", "(?:,?c|,){vp}"), ("tails", "question", ",[bmxh]n?r$"),
    ("sentences", "whole", "^{s1}(?:,?[cs]{s1})*$"), ("sentences", "fragment", "^{nps}{pp}*$"), ("sentences", "header", "^P+[zZ]*$"), ("sentences", "plea", "^y,?{s1}?$"),
    ("names", "name", "(?:u?P+(?:[Pu])*)"), ("names", "titled", "uP+"), ("names", "address", "[zZ]P+l?"), ("names", "owner", "P+o?N+"),
    ("name_equivalence", "also", "P+,?b?C{det}?P+"), ("name_equivalence", "is_a", "P+,?b{det}{adj}?N+"), ("name_equivalence", "announced", "k,?P+"),
)
FAMILIES = tuple(dict.fromkeys(f for f, _, _ in RULES))


@cache
def expanded(rule: str) -> str:
    """A rule with the rules that it names put in; rules can't contain themselves."""
    for _ in range(20):
        new = re.sub(r"\{(\w+)\}", lambda m: SHARED[m[1]], rule)
        if new == rule:
            return rule
        rule = new
    raise ValueError(f"a rule contains itself: {rule}")


def letter(word: Column) -> Column:
    """The class of a token as one letter."""
    closed = F.element_at(F.create_map(*[F.lit(x) for k, ws in CLOSED.items() for w in ws.split() for x in (w, k)]), F.lower(word))
    out = F.when(closed.isNotNull(), closed)
    for k, pattern in OPEN:
        out = out.when(word.rlike(pattern), k)
    return out.otherwise(NOUN)


def class_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, classes): a letter for each token of each sentence; runs without stops come in pieces."""
    s = docs.select("doc_id", F.posexplode(F.split("text", STOPS)).alias("sentence", "s"))
    whole = F.array_join(F.transform(F.regexp_extract_all("s", F.lit(TOKEN), 0), letter), "")
    return s.select("doc_id", "sentence", F.explode(F.regexp_extract_all(whole, F.lit(PIECE), 0)).alias("classes"))


def matched(sentences: DataFrame, family: str) -> DataFrame:
    """(doc_id, rule, n, words): how often each rule of a family matches in a document, and over how many words."""
    one = [F.struct(F.lit(name).alias("rule"), F.regexp_extract_all("classes", F.lit(expanded(rule)), 0).alias("found")) for f, name, rule in RULES if f == family]
    rows = sentences.select("doc_id", F.explode(F.array(*one)).alias("x")).select("doc_id", "x.rule", F.explode("x.found").alias("m")).filter("m <> ''")
    return rows.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.sum(F.length("m")).alias("words"))
