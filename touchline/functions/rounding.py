"""Two rounding rules are in use and they differ on halves.

* ``numeric`` and ``rate``: exact decimals, half away from zero. Used by the views
  and the two aggregate entry points.
* ``float_round``: binary doubles, half to even on ``x * 10**n``. Used by every
  metric derived later from already rounded values.

All return SQL expression text.
"""

from __future__ import annotations


def numeric(column: str) -> str:
    """Text or number as a decimal with a stated scale. Bad text raises."""
    return f"cast({column} as decimal(18,4))"


def float_round(expression: str, places: int = 2) -> str:
    factor = f"{10**places}D"
    return f"rint(cast({expression} as double) * {factor}) / {factor}"


def rate(total: str, weight: int, denominator: str, places: int, unit: int = 1) -> str:
    """``round(total * weight / denominator, places)``, null for a zero denominator.

    ``total`` is a whole number of ``1 / unit``. Both sides of the division are whole
    numbers, so the quotient keeps the most fraction digits a decimal can hold.
    """
    numerator = f"cast(({total}) * {weight} as decimal(20,0))"
    below = f"nullif(cast(({denominator}) * {unit} as decimal(18,0)), 0)"
    return f"round({numerator} / {below}, {places})"
