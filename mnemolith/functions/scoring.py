"""Scores of memory texts: actionability, quality, importance, kind, language, age decay, final rank.

Every score exists as a column expression and as SQL, both made from one table of rules. A null text
gives null scores; an empty one scores like any short text, but for importance (0.5, unknown).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .rules import Has, Longer, Points, Shorter, any_of, first_match, first_match_sql, total, total_sql

TECHNICAL = any_of([Has(p, True) for p in P.TECHNICAL])
_COMPLETE = Has(P.CURL_URL, True) | Has(P.FENCED) | Has(P.JSON_LIKE)
ACTIONABLE: Points = [(1, Has(P.URL_WITH_PATH)), (1, Has(P.HTTP_METHOD)), (1, Has(P.AUTH_WORD, True) & Has(P.ASSIGNED)), (1, _COMPLETE)]
ACTIONABLE_WITH_FRONTEND: Points = [*ACTIONABLE, (1, Has(P.SCRIPT_FILE) & Has(P.FRONTEND))]
BOILERPLATE = any_of([Has(p, True) for p in P.BOILERPLATE])
CREDENTIALS = any_of([Has(p, f) for p, f in P.CREDENTIALS])
_GENERIC = ~Has(r"\d") & ~Has("[A-Z][a-z]")
_SPECIFIC: Points = [(3, Has(P.NAMED_ENTITY)), (3, Has(P.MONEY)), (2, Has(P.PERCENT)), (2, Has(P.DATE_LIKE)), (1, Has(r"\d+"))]
QUALITY: Points = [
    (-3, Has(P.META_BEHAVIORAL[0], True) | Has(P.META_BEHAVIORAL[1], True) | Has(P.META_BEHAVIORAL[2], True) | Has(P.META_BEHAVIORAL[3], True)),
    *_SPECIFIC,
    (2, Has(P.DECIDED, True)),
    (2, Has(P.USER_FACT, True)),
    (2, Has(P.NAME_LIST)),
    (2, Has(P.CHAT_TOOL, True) & Has(P.TOOL_VERB, True)),
    (1, Longer(60)),
    (1, Has(P.ANY_FILE)),
    (1, Has(P.ROUTE) & Has(P.VALIDATION, True)),
    (1, Has(P.BRACKETED)),
    (-2, Shorter(25) & _GENERIC),
]
FACT: Points = [*_SPECIFIC, (1, Longer(50)), (-2, Shorter(30) & _GENERIC)]
#: In hundredths, so that halves round alike everywhere.
IMPORTANCE: Points = [
    (20, Has(P.CRITICAL, True)),
    (10, Has(P.TROUBLE, True)),
    (15, Has(P.PREFERENCE, True)),
    (10, Has(P.FULL_DATE)),
    (10, Has(P.BIG_NUMBER)),
    (10, Has(P.ANY_URL) & Longer(80)),
    (5, Has(P.NAME_LIST)),
    (5, Longer(150)),
    (-10, Has(P.UI_ACTION, True) & Shorter(80)),
    (20, Has(P.HEALTH, True)),
    (15, Has(P.ROLE, True)),
]
STATE = any_of([Has(p, True) for p in P.STATE_HINTS])
DECISION = any_of([Has(p, True) for p in P.DECISION_LANGUAGE])
DISQUALIFIED = [(f"boilerplate_{i + 1}", Has(p, True)) for i, p in enumerate(P.BOILERPLATE)] + [(f"credential_{i + 1}", Has(p, f)) for i, (p, f) in enumerate(P.CREDENTIALS)]


def actionability(text: Column, frontend: bool = True, lower: Column | None = None) -> Column:
    """0 to 5; 0 if not technical."""
    return F.when(TECHNICAL.column(text, lower), F.least(F.lit(5), 1 + total(ACTIONABLE_WITH_FRONTEND if frontend else ACTIONABLE, text, lower))).otherwise(F.when(text.isNotNull(), 0))


def actionability_sql(text: str, frontend: bool = True) -> str:
    return f"CASE WHEN {TECHNICAL.sql(text)} THEN least(5, 1 + {total_sql(ACTIONABLE_WITH_FRONTEND if frontend else ACTIONABLE, text)}) WHEN {text} IS NOT NULL THEN 0 END"


def _by_actionability(score: Column, then) -> Column:
    return F.transform(F.array(score), then)[0]


def memory_quality(text: Column, lower: Column | None = None) -> Column:
    # Looked at once: the score of an array of one.
    adjust = _by_actionability(actionability(text, lower=lower), lambda a: F.when((a == 1) & ~Has(P.CONTEXT, True).column(text, lower), -2).when(a >= 4, 2).otherwise(0))
    return F.when(BOILERPLATE.column(text, lower) | CREDENTIALS.column(text, lower), -10).otherwise(F.when(text.isNotNull(), total(QUALITY, text, lower) + adjust))


def memory_quality_sql(text: str) -> str:
    a = f"({actionability_sql(text)})"
    adjust = f"CASE WHEN {a} = 1 AND NOT {Has(P.CONTEXT, True).sql(text)} THEN -2 WHEN {a} >= 4 THEN 2 ELSE 0 END"
    return f"CASE WHEN {BOILERPLATE.sql(text)} OR {CREDENTIALS.sql(text)} THEN -10 WHEN {text} IS NOT NULL THEN {total_sql(QUALITY, text)} + {adjust} END"


def fact_quality(text: Column, lower: Column | None = None) -> Column:
    adjust = _by_actionability(actionability(text, frontend=False, lower=lower), lambda a: F.when(a == 1, -1).when(a >= 4, 1).otherwise(0))
    return F.when(BOILERPLATE.column(text, lower), -10).otherwise(F.when(text.isNotNull(), total(FACT, text, lower) + adjust))


def fact_quality_sql(text: str) -> str:
    a = f"({actionability_sql(text, False)})"
    return f"CASE WHEN {BOILERPLATE.sql(text)} THEN -10 WHEN {text} IS NOT NULL THEN {total_sql(FACT, text)} + CASE WHEN {a} = 1 THEN -1 WHEN {a} >= 4 THEN 1 ELSE 0 END END"


def importance(text: Column, lower: Column | None = None) -> Column:
    """0.1 to 1.0 in tenths, halves up; 0.5 for an empty text."""
    tenths = F.floor((20 + total(IMPORTANCE, text, lower) + 5) / 10)
    return F.when(text == "", 0.5).when(text.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), tenths)) / 10.0)


def importance_sql(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0.5 WHEN {text} IS NOT NULL THEN greatest(1, least(10, floor((20 + {total_sql(IMPORTANCE, text)} + 5) / 10.0))) / 10.0 END"


def kind(text: Column, lower: Column | None = None) -> Column:
    return F.when(STATE.column(text, lower), "state").otherwise(F.when(text.isNotNull(), "fact"))


def kind_sql(text: str) -> str:
    return f"CASE WHEN {STATE.sql(text)} THEN 'state' WHEN {text} IS NOT NULL THEN 'fact' END"


def disqualified(text: Column, lower: Column | None = None) -> Column:
    return first_match(DISQUALIFIED, text, lower)


def disqualified_sql(text: str) -> str:
    return first_match_sql(DISQUALIFIED, text)


def language_hint(text: Column) -> Column:
    """pt-BR if two or more of the markers stand in the text, as words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.isin(P.PORTUGUESE_MARKERS))
    return F.when(F.size(words) >= 2, "pt-BR")


def should_enrich(text: Column, verbatim: Column, skipped: Column) -> Column:
    """Technical, API-shaped, of little actionability, and neither verbatim nor exempt."""
    shaped = any_of([Has(P.ANY_URL, True), Has(P.TECHNICAL[1], True), Has(P.TECHNICAL[2], True)]).column(text)
    return TECHNICAL.column(text) & (actionability(text) <= 2) & shaped & ~verbatim & ~skipped


def age_decay(reference: Column, as_of: Column, importance_: Column, kind_: Column) -> Column:
    """2 ** (-days / half-life); 1 without a date or for the future. The half-life depends on importance and kind."""
    days = (F.unix_micros(as_of) - F.unix_micros(reference)) / F.lit(86_400_000_000.0)
    half = F.when(importance_ >= P.PROTECTED_IMPORTANCE, P.HALF_LIFE_PROTECTED).when(kind_ == "state", P.HALF_LIFE_STATE).otherwise(P.HALF_LIFE_FACT)
    return F.when(reference.isNull() | (days <= 0), 1.0).otherwise(F.pow(F.lit(2.0), -days / half))


def tier(reference: Column, as_of: Column, global_scope: Column) -> Column:
    days = (F.unix_micros(as_of) - F.unix_micros(reference)) / F.lit(86_400_000_000.0)
    return F.when(reference.isNull() | (days < 7), "hot").when(global_scope | (days < 30), "warm").otherwise("cold")


def term_boost(text: Column, terms: Column) -> Column:
    """A tenth of the share of terms that stand in the text; 0 without terms."""
    lower = F.lower(text)
    found = F.size(F.filter(terms, lambda t: F.contains(lower, F.lower(t))))
    return F.when(F.size(terms) > 0, found / F.size(terms) * 0.1).otherwise(0.0)


def adjusted_score(cosine: Column, decay: Column, importance_: Column, confidence: Column, boost: Column) -> Column:
    c, i, f = (F.coalesce(x, F.lit(0.5)) for x in (cosine, importance_, confidence))
    return F.least(F.lit(1.0), (0.5 * c + 0.3 * decay + 0.2 * i) * (0.5 + 0.5 * f) + boost)


def relevance_importance(relevance: Column) -> Column:
    out = F.lit(0.5)
    for k, v in P.RELEVANCE_IMPORTANCE.items():
        out = F.when(relevance == k, v).otherwise(out)
    return out
