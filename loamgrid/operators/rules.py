"""Rule engine.  Rules are short driver-side tables; they become one ``CASE`` over constant patterns, so every
pattern is compiled once per task, evaluation stops at the first hit, and no join is planned."""
from __future__ import annotations

import re
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import (CHUNK_DEFAULT, CHUNK_RULES, DEFAULT_NAMESPACE, NAMESPACE_RULES, PAGE_DEFAULT,
                                    PAGE_RULES, PROFILE_DEPARTMENTS, PROFILE_PATTERN, PROFILE_URL_PART, Rule)

def rules_from(df: DataFrame, pattern: str, labels: Sequence[str], order: str) -> list[Rule]:
    """Read a rule table.  Its rules become one expression, so it has to be as short as a person can write it."""
    rows = df.select(order, pattern, *labels).collect()
    return [Rule(r[pattern], tuple(r[c] for c in labels)) for r in sorted(rows, key=lambda r: r[order])]


def ascii_words(pattern: str) -> str:
    """Give word borders their ASCII meaning; Java's own depends on its version."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those within brackets left together."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        step = pattern[at:at + 2] if pattern[at] == "\\" else pattern[at]
        depth += (step in "([") - (step in ")]")
        if step == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += step
        at += len(step)
    return out


def needed_words(alternative: str) -> list[str]:
    """Lower-case strings of which every match of the alternative holds at least one; empty if none can be told.

    Read are letters, digits and blanks, escapes, classes and groups without groups of their own; a group between word
    borders needs one of its branches, any other group nothing."""
    if re.search(r"[{}^$]|\(\?|\([^()]*\(", alternative):
        return []
    whole = re.fullmatch(r"\\b\(([^()]*)\)\\b", alternative)
    found = []
    for branch in whole[1].split("|") if whole else [alternative]:
        bare = re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]|[^A-Za-z0-9 ]", "\n", branch)
        found.append(max(bare.split("\n"), key=len).lower())
    return found if all(found) else []


def matches(low: Column, pattern: str) -> Column:
    """Does the rule's pattern occur in the lower-case text?  Plain words among its alternatives are looked for as
    substrings, which is many times faster than a regular expression; others are tried only where words they need occur."""
    tests, rest = [], []
    for alternative in alternatives(pattern):
        words = [alternative.lower()] if re.fullmatch(r"[A-Za-z0-9 ]+", alternative) else needed_words(alternative)
        if not words:
            rest.append(alternative)
            continue
        held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(word)) for word in words])
        tests.append(held if words == [alternative.lower()] else held & low.rlike("(?i)" + ascii_words(alternative)))
    if rest:
        tests.append(low.rlike("(?i)" + ascii_words("|".join(rest))))
    return reduce(lambda a, b: a | b, tests)


def first_rule(text: Column, rules: Sequence[Rule]) -> Column:
    """Number of the first matching rule (from 1), one past the last if none matches."""
    chain = F.lit(len(rules) + 1)
    for number in range(len(rules), 0, -1):
        chain = F.when(matches(text, rules[number - 1].pattern), F.lit(number)).otherwise(chain)
    return chain


def first_match(text: Column, rules: Sequence[Rule], default: Sequence[str], names: Sequence[str]) -> Column:
    """Struct of the labels of the first rule whose pattern occurs in the lower-case text, else of ``default``."""
    def label(values: Sequence[str]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)])
    # The rule is found by number and its labels are looked up, so that taking three labels apart later does not
    # evaluate the patterns three times.
    table = F.array(*[label(r.labels) for r in rules], label(default))
    return tx.let(first_rule(text, rules), lambda number: F.element_at(table, number))


def all_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Distinct labels of every rule that matches the lower-case text, in rule order."""
    parts = [F.when(matches(text, r.pattern), F.array(*[F.lit(v) for v in r.labels]))
             .otherwise(F.array().cast("array<string>")) for r in rules]
    return F.array_distinct(F.concat(*parts))


def classify_page(url: Column, title: Column, text: Column, rules: Sequence[Rule] = PAGE_RULES,
                  default: Sequence[str] = PAGE_DEFAULT) -> Column:
    """Struct ``page_type, category, department``: a strong profile wins, then the first rule over URL, title and
    text together."""
    names = ("page_type", "category", "department")
    joined = F.lower(F.concat_ws(" ", url, title, text))

    def label(words: Column) -> Column:
        profile = F.contains(url, F.lit(PROFILE_URL_PART)) | matches(words, PROFILE_PATTERN)
        department = first_match(words, PROFILE_DEPARTMENTS, ("general",), ("department",))["department"]
        return F.when(profile, F.struct(F.lit("faculty").alias("page_type"), F.lit("Faculty").alias("category"),
                                        department.alias("department"))).otherwise(first_match(words, rules, default, names))
    return tx.let(joined, label)


def classify_chunk(text: Column, rules: Sequence[Rule] = CHUNK_RULES, default: Sequence[str] = CHUNK_DEFAULT) -> Column:
    """Struct ``category, namespace, page_type`` from the text of a chunk."""
    return tx.let(F.lower(text), lambda low: first_match(low, rules, default, ("category", "namespace", "page_type")))


def namespace_of(category: Column, rules: Sequence[Rule] = NAMESPACE_RULES,
                 default: str = DEFAULT_NAMESPACE) -> Column:
    return first_match(F.trim(F.lower(F.coalesce(category, F.lit("")))), rules, (default,), ("namespace",))["namespace"]
