"""Column expressions: metrics, statistics, vectors, parsers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0..1; null without trials."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def probability(log_odds: Column) -> Column:
    """Log odds as a percentage."""
    return 100 / (1 + F.exp(-log_odds))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Words of two characters or more, lower-cased; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def with_bigrams(text: Column) -> Column:
    """Words and word pairs of a text."""
    words = tokens(text)
    return F.concat(words, bigrams(words))


def parse_score(text: Column) -> Column:
    """The first number in a text, within 0..100; null without one."""
    number = F.nullif(F.regexp_extract(text, r"\b\d+(?:\.\d+)?\b", 0), F.lit("")).cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))


def parse_order(text: Column, n: Column) -> Column:
    """Positions 1..n as a listwise answer gives them; those it leaves out follow in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    said = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))
    return F.concat(said, F.array_except(F.sequence(F.lit(1), n), said))


def phrases(text: Column, count: int) -> Column:
    """The first lines of an answer without blanks, list marks and digits at either end, 2 to 80 characters long."""
    lines = F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x.rlike(r"(?U)\S"))
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(" -*\t.0123456789)")))
    return F.slice(F.filter(stripped, lambda x: F.length(x).between(2, 80)), 1, count)


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or df <= 0:
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return min(1.0, front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b)


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of the discordant counts."""
    n = b + c
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(b, c) + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))
