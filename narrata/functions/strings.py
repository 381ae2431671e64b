"""Scalar functions as Column expressions: URLs, markup, categories, number words, scripts, token classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
PUNCT = "[^A-Za-z0-9\\s]"
#: Suffixes that name the class of an unknown word.
NOUN_SUFFIX = "(action|age|ance|cy|dom|ee|ence|er|hood|ion|ism|ist|ity|ling|ment|ness|or|ry|scape|ship|ty)$"
VERB_SUFFIX = "(ate|ify|ise|ize)$"
ADJ_SUFFIX = "(able|ese|ful|i|ian|ible|ic|ish|ive|less|ly|ous)$"
ADV_SUFFIX = "(ward|wards|wise)$"


def url_encoded(c: Column) -> Column:
    """Percent encoding with %20 for blanks."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def url_decoded(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def stripped(html: Column) -> Column:
    """Tags become blanks, footnote marks and a few entities go, blanks collapse."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    t = F.regexp_replace(t, "\\[[0-9]+\\]", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))


def category(c: Column) -> Column:
    """Without trailing digits; of several words the last, in lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(c, "[0-9]+$", ""), "[ _]+"), -1))


def number_word(c: Column) -> Column:
    """Value of a cardinal or ordinal word, else null."""
    w = F.lower(c)
    pairs = [x for names in (CARDINALS, ORDINALS) for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]
    return F.element_at(F.create_map(*pairs), w)


def latin_only(c: Column) -> Column:
    """ASCII letters, dashes and apostrophes."""
    return c.rlike("^[A-Za-z'-]+$")


def unknown_class(w: Column) -> Column:
    """Morphological class of an unknown token: the first rule that holds."""
    return (
        F.when(w.rlike("[0-9]"), "--unk_digit--").when(w.rlike(PUNCT), "--unk_punct--").when(w.rlike("[A-Z]"), "--unk_upper--")
        .when(w.rlike(NOUN_SUFFIX), "--unk_noun--").when(w.rlike(VERB_SUFFIX), "--unk_verb--").when(w.rlike(ADJ_SUFFIX), "--unk_adj--")
        .when(w.rlike(ADV_SUFFIX), "--unk_adv--").otherwise("--unk--")
    )


#: Token kinds in the order in which a reader tries them.
KINDS = (
    ("web", "[a-z]+://[^\\s]+|www\\.[^\\s]+"),
    ("email", "[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"),
    ("date", "[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"),
    ("time", "[0-9]{1,2}:[0-9]{2}"),
    ("number", "[0-9]+(?:[.,][0-9]+)*"),
    ("contraction", "\\p{L}+(?:n't|'\\p{Ll}+)"),
    ("word", "\\p{L}+(?:-\\p{L}+)*"),
    ("mark", "[^\\s\\p{L}0-9]"),
)
TOKEN_PATTERN = "|".join(p for _, p in KINDS)


def token_kind(w: Column) -> Column:
    out = F.when(w.rlike(f"^(?:{KINDS[0][1]})$"), KINDS[0][0])
    for name, pattern in KINDS[1:]:
        out = out.when(w.rlike(f"^(?:{pattern})$"), name)
    return out


#: Words that name times, by kind.
TIME_WORDS = {
    "month": "january february march april may june july august september october november december",
    "weekday": "monday tuesday wednesday thursday friday saturday sunday",
    "season": "spring summer autumn fall winter",
    "part_of_day": "morning noon afternoon evening night midnight dawn dusk",
    "unit": "second seconds minute minutes hour hours day days week weeks month months year years century centuries",
    "relative": "today tomorrow yesterday tonight now then soon later before after ago",
}


def time_word(c: Column) -> Column:
    """The kind of a word that names a time, else null."""
    w = F.lower(c)
    out = F.when(F.lit(False), "")
    for kind, ws in TIME_WORDS.items():
        out = out.when(w.isin(*ws.split()), kind)
    return out


def code_points(c: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX, of four hexadecimal digits or more."""

    def written(x: Column) -> Column:
        digits = F.hex(F.ascii(x))
        return F.when(F.ascii(x) > 127, F.concat(F.lit("\\u"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), written), "")
