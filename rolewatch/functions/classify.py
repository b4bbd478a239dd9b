"""Classifiers and predicates over titles, descriptions and event pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ANY, EDGE, END, START, escape_pattern, let, lit_true, null_if_blank, text_or_empty, trim_text

# The vocabulary that decides what counts as an early-career role.
INTERNSHIP = rf"(?i){START}(?:intern|internship|co[ -]?op){END}"
NEW_GRAD = (
    rf"(?i){START}(?:new grad(?:uate)?|graduate (?:role|program)"
    rf"|graduate {ANY}{{0,30}}{START}(?:engineer|developer)|entry[ -]level){END}"
)
EARLY_CAREER = rf"(?i){START}(?:early career|apprentice|apprenticeship){END}"
ADVANCED_DEGREE = (
    rf"(?i){START}(?:master(?:'s|s)?|mba|ph\.?d\.?|doctoral|doctorate|post[ -]?doc(?:toral)?"
    rf"|graduate {ANY}{{0,30}}{START}intern|high school|secondary school){EDGE}"
)
HIRING_TEAM = (
    rf"(?i){START}(?:recruiter|recruiting|talent acquisition|campus recruiting|university recruiting"
    rf"|program manager){END}|{START}manager{END}{ANY}*{START}intern(?:ship)? program{END}"
)
NAVIGATION = (
    r"(?i)^(?:early careers?|internships?(?: for students)?|university recruiting|explore |find |view "
    r"|search jobs?|watch (?:the )?film)"
)
EARLY_CAREER_EVENT = (
    rf"{START}(?:internships?|students?|early career|new grads?|graduates?|university|campus"
    rf"|resume workshop|career workshop|hackathon|recruiting event){END}"
)

# Keywords that gate a kind of role instead of naming a field of work.
INTERNSHIP_KEYWORDS = ["intern", "internship", "university"]
NEW_GRAD_KEYWORDS = ["new grad", "graduate", "early career"]
GENERIC_KEYWORDS = INTERNSHIP_KEYWORDS + NEW_GRAD_KEYWORDS

# Event types in order of precedence.
EVENT_TYPES = [
    ("WORKSHOP", "workshop"),
    ("HACKATHON", "hackathon"),
    ("OFFICE_HOURS", "office hours"),
    ("INFO_SESSION", "info(?:rmation)? session"),
    ("CONFERENCE", "conference"),
    ("NETWORKING", "network"),
    ("CAMPUS_RECRUITING", "campus|university|recruit"),
]


def employment_type(title: Column, raw_type: Column | None = None) -> Column:
    raw = F.lit("") if raw_type is None else text_or_empty(raw_type)
    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), raw))
    return let(
        text,
        lambda t: F.when(t.rlike(INTERNSHIP), "INTERNSHIP")
        .when(t.rlike(NEW_GRAD), "NEW_GRAD")
        .when(t.rlike(EARLY_CAREER), "EARLY_CAREER")
        .otherwise("OTHER"),
    )


def is_eligible_title(title: Column) -> Column:
    """An undergraduate internship or a new-graduate role, not a recruiter's own job or a menu entry."""
    return lit_true(
        let(
            trim_text(title),
            lambda t: ~t.rlike(HIRING_TEAM)
            & ~t.rlike(NAVIGATION)
            & (t.rlike(NEW_GRAD) | (t.rlike(INTERNSHIP) & ~t.rlike(ADVANCED_DEGREE))),
        )
    )


def clean_keywords(values: Column) -> Column:
    lowered = F.transform(
        F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(trim_text(v))
    )
    return F.array_distinct(F.filter(lowered, lambda v: lit_true(v != "")))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mark_edges(value: Column) -> Column:
    """Text with a mark where no word character stands before, and another where none follows.

    A keyword stands in a text as a whole exactly if the marked keyword occurs in the marked text: inside they have the same marks, and at its
    ends the keyword has those of an edge.  So keywords need no pattern of their own.
    """
    after = F.regexp_replace(value, r"(?<!\w)", "\uFDD1")
    return F.regexp_replace(after, r"(?<!\uFDD1)(?=\uFDD1?(?:[^\w\uFDD1]|\z))", "\uFDD2")


def keyword_rules(role_keywords: Column) -> Column:
    """What a target's keywords demand: kinds of role allowed, and the keywords for the fields of work, plain and with their word edges marked.

    Evaluate it once per target, before the join to postings.
    """
    cleaned = clean_keywords(role_keywords)

    def rules(words: Column) -> Column:
        generic = F.array_intersect(words, _texts(GENERIC_KEYWORDS))
        specific = F.array_except(words, _texts(GENERIC_KEYWORDS))
        ungated = F.size(generic) == 0
        return F.struct(
            (ungated | F.arrays_overlap(generic, _texts(INTERNSHIP_KEYWORDS))).alias("internships"),
            (ungated | F.arrays_overlap(generic, _texts(NEW_GRAD_KEYWORDS))).alias("new_grads"),
            specific.alias("plain"),
            F.transform(specific, lambda w: mark_edges(w)).alias("marked"),
        )

    return let(cleaned, rules)


def satisfies_rules(title: Column, description: Column, rules: Column) -> Column:
    """The company's own part of the match, for titles already known to be eligible."""
    allowed = F.when(title.rlike(INTERNSHIP), rules["internships"]).otherwise(rules["new_grads"])
    haystack = F.lower(F.concat(title, F.lit(" "), text_or_empty(description)))
    # Most keywords do not occur at all; only where one does are the edges of the text marked.
    at_edges = let(haystack, lambda text: F.exists(rules["plain"], lambda w: F.contains(text, w)) & let(
        F.when(F.exists(rules["plain"], lambda w: F.contains(text, w)), mark_edges(text)),
        lambda marked: F.exists(rules["marked"], lambda w: F.contains(marked, w)),
    ))
    named = F.when(F.size(rules["plain"]) == 0, F.lit(True)).otherwise(at_edges)
    return lit_true(allowed & named)


def matches_keywords(title: Column, description: Column, role_keywords: Column) -> Column:
    own = let(keyword_rules(role_keywords), lambda rules: satisfies_rules(title, description, rules))
    return is_eligible_title(title) & own


def search_queries(role_keywords: Column, limit: int | None = None) -> Column:
    """Search terms a job board is asked for on behalf of a target: all, or the first ``limit`` of its own."""

    def terms(words: Column) -> Column:
        specific = F.array_except(words, _texts(GENERIC_KEYWORDS))
        interns = F.arrays_overlap(words, _texts(["intern", "internship"]))
        graduates = F.arrays_overlap(words, _texts(NEW_GRAD_KEYWORDS))
        generic = F.array_compact(F.array(F.when(interns, F.lit("intern")), F.when(graduates, F.lit("new grad"))))
        return (
            F.when(F.size(specific) > 0, specific if limit is None else F.slice(specific, 1, limit))
            .when(F.size(words) == 0, _texts(["intern", "new grad"]))
            .when(F.size(generic) > 0, generic)
            .otherwise(_texts(["intern"]))
        )

    return let(clean_keywords(role_keywords), terms)


def event_type(title: Column) -> Column:
    chain = F.when(F.lit(False), F.lit("OTHER"))
    for name, pattern in EVENT_TYPES:
        chain = chain.when(title.rlike(f"(?i)(?:{pattern})"), name)
    return chain.otherwise("OTHER")


def location_in_title(title: Column) -> Column:
    """The place named after " at ", when there is one."""
    pattern = rf"(?i){START}at\s+(?:Google\s+)?({ANY}+)\z"
    return null_if_blank(trim_text(F.regexp_extract(title, pattern, 1)))


def event_format(text: Column) -> Column:
    return F.when(text.rlike("(?i)virtual|online"), "VIRTUAL").otherwise("IN_PERSON")


def event_audience(text: Column) -> Column:
    return F.array(
        F.when(text.rlike("(?i)intern"), "Internship candidates").otherwise("Early-career candidates")
    )


def is_early_career_event(title: Column, description: Column, event_keywords: Column) -> Column:
    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(description)))
    words = F.coalesce(event_keywords, F.array().cast("array<string>"))
    return lit_true(
        let(
            text,
            lambda t: t.rlike(EARLY_CAREER_EVENT) | F.exists(words, lambda w: t.contains(F.lower(w))),
        )
    )
