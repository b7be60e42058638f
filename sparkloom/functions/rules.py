"""Ordered rules as CASE expressions: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and their order, question words and section names.
LIVE_HOSTS = ("ghr.nlm.nih.gov", "cancer.gov", "nhlbi.nih.gov")
ARCHIVE_HOSTS = ("niddk.nih.gov", "ninds.nih.gov")
BROWSER_HOST = "rarediseases.info.nih.gov"
DATED_HOST, DATED_AT = "cdc.gov", "20140101"
SECTION_WORDS = (
    (("cause", "genetic changes"), "Causes"),
    (("inherit",), "Inheritance"),
    (("common", "how many people"), "Frequency"),
    (("treatment", "manage"), "Treatment"),
    (("symptom", "signs"), "Symptoms"),
)
SENIOR_TYPES = (
    (("information",), "[DEFINITIONS]"),
    (("causes", "susceptibility", "prevention"), "[RISK FACTORS AND PREVENTIONS]"),
    (("symptoms", "exams and tests", "treatment", "complications", "outlook"), "[SYMPTOMS AND DIAGNOSIS AND TREATMENTS]"),
    (("faq",), "[FAQ]"),
)


def any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def first_of(cases, otherwise=None) -> Column:
    """CASE WHEN over (condition, value) pairs in their order."""
    (cond, value), *rest = cases
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def authority(url: Column) -> Column:
    """Host with user and port, or an empty string."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def fetch_mode(domain: Column, url_path: Column) -> Column:
    """live, wayback or browser."""
    natural = domain.contains("nlm.nih.gov") & url_path.contains("medlineplus") & url_path.contains("natural")
    return first_of(
        [
            (any_of(domain, LIVE_HOSTS), F.lit("live")),
            (natural, F.lit("wayback")),
            (any_of(domain, ARCHIVE_HOSTS), F.lit("wayback")),
            (domain.contains(BROWSER_HOST), F.lit("browser")),
            (domain.contains(DATED_HOST), F.lit("wayback")),
        ],
        F.lit("live"),
    )


def archive_date(domain: Column, url_path: Column) -> Column:
    """The snapshot to ask for, where a rule names one."""
    return F.when((fetch_mode(domain, url_path) == "wayback") & domain.contains(DATED_HOST) & ~any_of(domain, ARCHIVE_HOSTS), F.lit(DATED_AT))


def bucket(domain: Column, ordered_hosts) -> Column:
    """The first of the hosts that the domain contains; null without any."""
    return first_of([(domain.contains(h), F.lit(h)) for h in ordered_hosts])


def question_section(question: Column) -> Column:
    q = F.lower(question)
    return first_of([(any_of(q, words), F.lit(name)) for words, name in SECTION_WORDS], F.lit("Description"))


def senior_section(question_type: Column) -> Column:
    q = F.lower(question_type)
    return first_of([(q.isin(*types), F.lit(name)) for types, name in SENIOR_TYPES])


def reach_status(source: Column) -> Column:
    """live, wayback or skipped by the label of where a page came from."""
    return first_of([(source.isNull(), F.lit("skipped")), ((source == "Live") | source.contains("Playwright"), F.lit("live"))], F.lit("wayback"))


def usable_page(html: Column) -> Column:
    return html.isNotNull() & (html != "") & ~html.contains("This Page Has Moved") & ~html.contains("Redirect to first topic")
