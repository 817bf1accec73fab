"""English stop words and stems, as rules that columns and SQL are made of.

A step tries its rules in order: the first ending a word has decides, and its replacement is made only if what stands before the ending fits the rule's conditions (rules of
one ending are tried one after the other)."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_once

# Words without meaning of their own.
STOP_WORDS = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())


class Ending(NamedTuple):
    ending: str
    replacement: str
    region: str | None = None            # patterns that what stands before the ending has to match
    before: str | None = None


# The published suffix rules for English (second version), step by step.  Y is a y that counts as a consonant, # marks where a verb ending was.
FIRST = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SECOND = FIRST + "[^aeiouy]*[aeiouy]+[^aeiouy]"
LATE_REGIONS = {"gener": "g1ner", "commun": "c1mmun", "arsen": "1rsen"}        # beginnings whose first vowel does not open the first region: it is hidden
VOWEL, SHORT_WORD = "[aeiouy]", "^(?:[^aeiouy]+[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])$"
NO_SHORT_SYLLABLE = "(?:[aeiouy]|.[aeiouy][wxY]|[^aeiouy][^aeiouy]|[aeiouy][aeiouy][^aeiouy])$"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
              "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
              **{w: w for w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")},
              "innings": "inning", "outings": "outing", "cannings": "canning", "herrings": "herring", "earrings": "earring", "proceeds": "proceed", "exceeds": "exceed", "succeeds": "succeed"}
STEPS = (
    (Ending("sses", "ss"), Ending("ied", "i", "..$"), Ending("ied", "ie"), Ending("ies", "i", "..$"), Ending("ies", "ie"), Ending("us", "us"), Ending("ss", "ss"),
     Ending("s", "", "[aeiouy].+$")),
    (Ending("eedly", "ee", FIRST), Ending("ingly", "#", VOWEL), Ending("edly", "#", VOWEL), Ending("eed", "ee", FIRST), Ending("ing", "#", VOWEL), Ending("ed", "#", VOWEL)),
    (Ending("at#", "ate"), Ending("bl#", "ble"), Ending("iz#", "ize"), *(Ending(c + c + "#", c) for c in "bdfgmnprt"), Ending("#", "e", SHORT_WORD), Ending("#", "")),
    (Ending("y", "i", ".[^aeiouy]$"), Ending("Y", "i", ".[^aeiouy]$")),
    (Ending("ization", "ize", FIRST), Ending("ational", "ate", FIRST), Ending("fulness", "ful", FIRST), Ending("ousness", "ous", FIRST), Ending("iveness", "ive", FIRST),
     Ending("tional", "tion", FIRST), Ending("biliti", "ble", FIRST), Ending("lessli", "less", FIRST), Ending("entli", "ent", FIRST), Ending("ation", "ate", FIRST),
     Ending("alism", "al", FIRST), Ending("aliti", "al", FIRST), Ending("ousli", "ous", FIRST), Ending("iviti", "ive", FIRST), Ending("fulli", "ful", FIRST),
     Ending("enci", "ence", FIRST), Ending("anci", "ance", FIRST), Ending("abli", "able", FIRST), Ending("izer", "ize", FIRST), Ending("ator", "ate", FIRST),
     Ending("alli", "al", FIRST), Ending("bli", "ble", FIRST), Ending("ogi", "og", FIRST, "l$"), Ending("li", "", FIRST, "[cdeghkmnrt]$")),
    (Ending("ational", "ate", FIRST), Ending("tional", "tion", FIRST), Ending("alize", "al", FIRST), Ending("icate", "ic", FIRST), Ending("iciti", "ic", FIRST),
     Ending("ative", "", SECOND), Ending("ical", "ic", FIRST), Ending("ness", "", FIRST), Ending("ful", "", FIRST)),
    (*(Ending(e, "", SECOND) for e in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize")), Ending("ion", "", SECOND, "[st]$"),
     *(Ending(e, "", SECOND) for e in ("al", "er", "ic"))),
    (Ending("e", "", SECOND), Ending("e", "", FIRST, NO_SHORT_SYLLABLE), Ending("l", "", SECOND, "l$")),
)


def with_stems(words: DataFrame, word: str, stem: str) -> DataFrame:
    """Add the stem of a lower-case word; words of one or two letters, and words with other signs than a-z, stay.  Meant for a table of different words."""
    start = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    for beginning, hidden in LATE_REGIONS.items():
        start = F.regexp_replace(start, f"^{beginning}", hidden)
    out = words.withColumn(stem, start)
    for step in STEPS:
        new = F
        for rule, following in zip(step, (*step[1:], None)):
            ends, front = F.endswith(stem, F.lit(rule.ending)), F.expr(f"left({stem}, length({stem}) - {len(rule.ending)})")
            fits = ends
            for pattern in (rule.region, rule.before):
                fits = fits & front.rlike(pattern) if pattern else fits
            new = new.when(fits, F.concat(front, F.lit(rule.replacement)))
            if following is None or following.ending != rule.ending:
                new = new.when(ends, F.col(stem))
        out = with_once(out, "_next", new.otherwise(F.col(stem))).withColumn(stem, F.col("_next")).drop("_next")
    plain = F.col(word).rlike("^[a-z]{3,}$")
    known = F.lit(None).cast("string")
    for exception, value in EXCEPTIONS.items():
        known = F.when(F.col(word) == exception, value).otherwise(known)
    shown = F.replace(F.col(stem), F.lit("Y"), F.lit("y"))
    for beginning, hidden in LATE_REGIONS.items():
        shown = F.replace(shown, F.lit(hidden), F.lit(beginning))
    return out.withColumn(stem, F.when(plain, F.coalesce(known, shown)).otherwise(F.col(word)))


def stems_sql(source: str, word: str) -> str:
    """The same as a chain of SQL tables, the last being ``stems (word, stem)``, over the column ``word`` of the table ``source``."""
    start, shown = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')", "replace(s, 'Y', 'y')"
    for beginning, hidden in LATE_REGIONS.items():
        start, shown = f"regexp_replace({start}, '^{beginning}', '{hidden}')", f"replace({shown}, '{hidden}', '{beginning}')"
    tables = [f"stem_0 AS (SELECT DISTINCT {word} AS word, {start} AS s FROM {source})"]
    for number, step in enumerate(STEPS):
        arms = []
        for rule, following in zip(step, (*step[1:], None)):
            front = f"left(s, length(s) - {len(rule.ending)})"
            fits = [f"ends_with(s, '{rule.ending}')"] + [f"regexp_matches({front}, '{p}')" for p in (rule.region, rule.before) if p]
            arms.append(f"WHEN {' AND '.join(fits)} THEN {front} || '{rule.replacement}'")
            if following is None or following.ending != rule.ending:
                arms.append(f"WHEN {fits[0]} THEN s")
        tables.append(f"stem_{number + 1} AS (SELECT word, CASE {' '.join(arms)} ELSE s END AS s FROM stem_{number})")
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())
    tables.append(f"stems AS (SELECT word, CASE WHEN NOT regexp_matches(word, '^[a-z]{{3,}}$') THEN word ELSE CASE word {known} ELSE {shown} END END AS stem FROM stem_{len(STEPS)})")
    return ", ".join(tables)
