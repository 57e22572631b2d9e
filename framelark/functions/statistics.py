"""P-values of paired tests, in closed form; inputs are a handful of pairs."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    made = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            made *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return made


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def wilcoxon_p(differences: list[float]) -> float | None:
    """Two-sided p-value of the signed-rank test: exact without ties and zeros up
    to 50 pairs, else the normal approximation; null if all are zero."""
    d = [x for x in differences if x]
    n = len(d)
    if not n:
        return None
    sizes = sorted(map(abs, d))
    rank = {v: (sizes.index(v) + 1 + len(sizes) - sizes[::-1].index(v)) / 2 for v in set(sizes)}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    least = min(plus, n * (n + 1) / 2 - plus)
    if n == len(differences) and len(rank) == n and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)  # sign patterns by their sum of ranks, one rank after another
        for r in range(1, n + 1):
            for total in range(len(ways) - 1, r - 1, -1):
                ways[total] += ways[total - r]
        hits = sum(ways[: int(least) + 1])
        return min(1.0, 2 * hits / 2**n)
    ties = sum(c**3 - c for c in (sizes.count(v) for v in rank))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(least - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0
