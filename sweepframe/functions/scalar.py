"""Scalar functions, as Column builders and as SQL functions for expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_UNROLLED_DEGREE = 6

# SQL bodies are expanded by Catalyst, so they cost no function call at run time.
#
# rnd and sci round the number itself, not its shortest decimal text as Spark's
# format_string does. The two differ only where that text is a tie, its last digit
# the 5 that is to be rounded away. Then the sign of (number - tie) decides, which
# the exact error of a product gives (Dekker's method).
_SQL_FUNCTIONS = {
    "ord": "(x STRING) RETURNS INT RETURN ascii(x)",
    "legendre": """(n INT, a DOUBLE, b DOUBLE, x DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN n = 0 THEN 1D ELSE aggregate(
            CASE WHEN n < 2 THEN CAST(array() AS ARRAY<INT>) ELSE sequence(1, n - 1) END,
            named_struct('p', 1D, 'q', -1D + 2D * (x - a) / (b - a)),
            (s, k) -> named_struct(
                'p', s.q,
                'q', ((2 * k + 1) * (-1D + 2D * (x - a) / (b - a)) * s.q - k * s.p) / (k + 1)),
            s -> s.q) END""",
    "float_high_part": "(a DOUBLE) RETURNS DOUBLE RETURN 134217729D * a - (134217729D * a - a)",
    "float_product_error": """(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN
        ((float_high_part(a) * float_high_part(b) - a * b)
         + float_high_part(a) * (b - float_high_part(b)) + (a - float_high_part(a)) * float_high_part(b))
        + (a - float_high_part(a)) * (b - float_high_part(b))""",
    # Sign of x - (whole + 1/2) / 10^places, for an x within rounding of that tie.
    "float_tie_side": """(x DOUBLE, whole BIGINT, places INT) RETURNS DOUBLE RETURN
        CASE WHEN places >= 0
            THEN (x * (2D * power(10D, places)) - (2 * whole + 1)) + float_product_error(x, 2D * power(10D, places))
            ELSE (2D * x - (2 * whole + 1) * power(10D, -places)) - float_product_error(2D * whole + 1, power(10D, -places))
        END""",
    "float_digits": """(x DOUBLE) RETURNS STRING RETURN
        regexp_replace(replace(split_part(format_string('%.16e', abs(x)), 'e', 1), '.', ''), '0+$', '')""",
    "float_exponent": "(x DOUBLE) RETURNS INT RETURN try_cast(split_part(format_string('%.16e', abs(x)), 'e', 2) AS INT)",
    # Digits before the final 5 of a tie at the given number of significant digits that
    # is to be rounded down; null for every other number.
    "float_rounded_down": """(x DOUBLE, significant INT, places INT) RETURNS STRING RETURN
        CASE WHEN significant BETWEEN 0 AND 15 AND abs(places) <= 22
                  AND length(float_digits(x)) = significant + 1 AND float_digits(x) LIKE '%5'
                  AND (float_tie_side(abs(x), TRY_CAST(concat('0', left(float_digits(x), significant)) AS BIGINT), places) < 0
                       OR (float_tie_side(abs(x), TRY_CAST(concat('0', left(float_digits(x), significant)) AS BIGINT), places) = 0
                           AND TRY_CAST(concat('0', left(float_digits(x), significant)) AS BIGINT) % 2 = 0))
             THEN left(float_digits(x), significant) END""",
    "fixed_text": """(x DOUBLE, n INT, kept STRING) RETURNS STRING RETURN
        CASE WHEN abs(x) >= 9007199254740992D AND abs(x) < 9.2e18D
             THEN concat(CAST(try_cast(x AS BIGINT) AS STRING), CASE WHEN n > 0 THEN concat('.', repeat('0', n)) ELSE '' END)
             WHEN kept IS NULL THEN format_string(concat('%.', n, 'f'), x)
             ELSE concat(CASE WHEN x < 0 THEN '-' ELSE '' END,
                         left(lpad(kept, greatest(n + 1, length(kept)), '0'), greatest(n + 1, length(kept)) - n),
                         CASE WHEN n > 0 THEN concat('.', right(lpad(kept, greatest(n + 1, length(kept)), '0'), n)) ELSE '' END)
        END""",
    "rnd": """(x DOUBLE, n INT) RETURNS STRING RETURN
        fixed_text(x, n, float_rounded_down(x, n + 1 + float_exponent(x), n))""",
    "scientific_text": """(x DOUBLE, n INT, kept STRING) RETURNS STRING RETURN
        CASE WHEN kept IS NULL THEN format_string(concat('%.', n, 'e'), x)
             ELSE concat(CASE WHEN x < 0 THEN '-' ELSE '' END, left(kept, 1),
                         CASE WHEN n > 0 THEN concat('.', substring(kept, 2)) ELSE '' END,
                         'e', split_part(format_string('%.16e', abs(x)), 'e', 2))
        END""",
    "sci": """(x DOUBLE, n INT) RETURNS STRING RETURN
        scientific_text(x, n, float_rounded_down(x, n + 1, n - float_exponent(x)))""",
}


def register_functions(spark: SparkSession) -> None:
    """Make ``legendre``, ``rnd``, ``sci`` and ``ord`` usable in SQL expressions."""
    for name, definition in _SQL_FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")


def legendre(n: int, a: float | Column, b: float | Column, x: Column) -> Column:
    """Legendre polynomial of fixed degree ``n`` on the domain [a, b]."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b))
    u = F.lit(2.0) * (x - low) / (high - low) - F.lit(1.0)
    if n > _UNROLLED_DEGREE:
        register_functions(SparkSession.active())
        return F.call_function("legendre", F.lit(n), low, high, x.cast("double"))
    previous, current = F.lit(0.0), F.lit(1.0)
    for k in range(n):
        previous, current = current, (F.lit(2.0 * k + 1) * u * current - F.lit(float(k)) * previous) / F.lit(k + 1.0)
    return current


def rnd(x: Column, n: int | Column) -> Column:
    """Fixed decimals, rounded as the exact number is; ties go to the even digit.

    From 2**63 on, digits beyond the shortest text of the number are zeros.
    """
    return _formatted("rnd", x, n)


def sci(x: Column, n: int | Column) -> Column:
    """Scientific notation with ``n`` decimals, rounded as in :func:`rnd`."""
    return _formatted("sci", x, n)


def _formatted(function: str, x: Column, n: int | Column) -> Column:
    register_functions(SparkSession.active())
    return F.call_function(function, x.cast("double"), n if isinstance(n, Column) else F.lit(n))
