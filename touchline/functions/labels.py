"""Display values that are data: outcome, score text, opponent text, image address,
age. All return SQL expression text."""

from __future__ import annotations

# Fixed value: address pattern of the team image, keyed by team code.
SHIRT_URL = ("https://fantasy.premierleague.com/dist/img/shirts/standard/shirt_", "-66.webp")


def outcome() -> str:
    """From the player's side; ``?`` without a score."""
    return (
        "case when home_score is null or away_score is null then '?'"
        " when home_score = away_score then 'D'"
        " when (home_score > away_score) = was_home then 'W' else 'L' end"
    )


def score_text() -> str:
    return "case when home_score is null then '-' else concat(home_score, '-', away_score) end"


def versus(opponent: str, venue: str) -> str:
    """``ABC (H)``"""
    return f"concat({opponent}, ' (', {venue}, ')')"


def venue() -> str:
    return "case when was_home then 'H' else 'A' end"


def shirt_url(team_code: str) -> str:
    head, tail = SHIRT_URL
    return f"concat('{head}', {team_code}, '{tail}')"


def age_label(then: str, seconds: str) -> str:
    """Age in whole minutes, hours or days; below a minute ``just now``.

    ``seconds`` is the whole number of seconds since ``then``.
    """
    return (
        f"case when {then} is null or {seconds} is null then null"
        f" when {seconds} < 60 then 'just now'"
        f" when {seconds} < 3600 then concat({seconds} div 60, 'm ago')"
        f" when {seconds} < 86400 then concat({seconds} div 3600, 'h ago')"
        f" else concat({seconds} div 86400, 'd ago') end"
    )
