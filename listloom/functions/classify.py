"""Message categories by ordered patterns: the first that a subject matches wins, else technical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and their patterns, in order.
WHEN_PARSED = {
    "job": r"hiring|position[s]?\b|opportunit|career|recruit|job\b|talent|now hiring|director.*(role|search)|scientist role|looking for",
    "workshop": r"workshop|course\b|training|registration|PAGE \d{4}|webinar|symposium|conference|summer school",
    "announcement": r"\brelease\b|now available|version \d|new member|PDx-Pop \d|Wings for NONMEM",
}
WHEN_BUILT = {
    "admin": (
        r"\bunsubscri|\bsubscri|remove me|sign.?off\b|\bvirus\b|\bspam\b|do not open|phishing|^test\b|test message|"
        r"please ignore|do not respond|linkedin|^To:|email\s*protected"
    ),
    "event": (
        r"workshop|courses?\b|training|registration|diploma|PAGE\s?\d{4}|PAGANZ|webinar|symposium|conference|congress|"
        r"summer school|\bmeeting\b.*\d{4}|\d{4}.*\bmeeting\b|\bat PAGE\b|ACoP\d*\b|\bWCoP\b|"
        r"\bISOP\b.*(?:webinar|session)|\bASCPT\b|save the date|mark your calendar|register for|tutorial|"
        r"PDx-Pop\s+workshop|call for.*program|call for.*abstract|call for.*paper|\bAPN\b|\bPKUK\b|\bQSPC\b|\bUPSS\b"
    ),
    "job": (
        r"hiring|position[s]?\b|opportunit|career|recruit|job\b|talent|now hiring|"
        r"director\b.*(?:role|search|quantitative|pharmacol|pharmacomet)|scientists?\b|researchers?\b|"
        r"looking for\b.*(?:scientist|modeler|pharmacomet|analyst|candidate|talent|person)|fellowship|postdoc|"
        r"post.?doc|vacancy|vacanc|openings?\b|associate director|senior.*(?:scientist|manager)|pharmacometrician|"
        r"apply\b.*(?:role|position)|we are seeking|join our|join the|head of|vice president|\bVP\b.*pharm|wanted|"
        r"\bintern\b|\binternship|faculty|professor|tenure|modelers?\b.*(?:for|at|in)|laboratory|studentship|"
        r"expert\b.*(?:in|at|for)|(?:pharmacomet|PK.?PD|MIDD).*(?:in\s+\w+,|germany|usa|uk|france)|"
        r"call for applications|PhD program|lecturer\b|collaborator\w*\s+sought|sought\b|call for.*members?\b|"
        r"calling all\b|(?:pharmaco|PK.?PD|clinical|remote|senior)\w*\s+role|"
        r"role\b.*(?:pharmaco|PK|clinical|remote|senior)|leverage your skills"
    ),
    "news": (
        r"\breleased?\b|available from\b|now available|version \d|new member|Wings for NONMEM|\bWFN\b|sad news|"
        r"passing of|passed away|funeral|in memoriam|obituary|\bR package\b|\bpython package\b|an? \w+ package for|"
        r"^new software$|^new tool\b|software update|distribution of NONMEM|update.*available|"
        r"^\w+ (?:design )?software\b|bug list|change\s*log|patch\b|discussion group\b|user group\b|"
        r"citations.*archive|^new journal$"
    ),
}
OTHERWISE = "technical"
CATEGORIES = ("admin", "event", "job", "news", OTHERWISE)


def category(subject: Column, patterns: dict[str, str] = WHEN_BUILT) -> Column:
    """Null counts as blank, which is technical."""
    subject, out = F.coalesce(subject, F.lit("")), F
    for name, pattern in patterns.items():
        out = out.when(subject.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(OTHERWISE)
