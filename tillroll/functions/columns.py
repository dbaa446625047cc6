"""Column expressions shared by the operators (all built-in, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.schemas import CANCEL_PREFIX, MONEY


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_revenue(quantity: str | Column = "Quantity", price: str | Column = "UnitPrice") -> Column:
    """Quantity · UnitPrice, exact decimal."""
    return col_(quantity) * col_(price)


def money_sum(c: str | Column) -> Column:
    """Exact sum of money as decimal(38, 3)."""
    return F.sum(col_(c)).cast(MONEY)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null (not an error) when den is 0 or null."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def pct_growth(current: str | Column, previous: str | Column) -> Column:
    """(current − previous) / previous · 100 as double; null when previous is 0/null."""
    cur, prev = col_(current).cast("double"), col_(previous).cast("double")
    return F.try_divide(cur - prev, prev) * F.lit(100.0)


def is_cancelled(invoice: str | Column = "InvoiceNo") -> Column:
    """Invoice numbers that start with the (case-sensitive) cancel prefix."""
    return col_(invoice).startswith(CANCEL_PREFIX)


def year_month_label(year: str | Column = "Year", month: str | Column = "Month") -> Column:
    """'YYYY-MM' label, sortable as text."""
    return F.format_string("%d-%02d", col_(year), col_(month))


def cluster_display_name(cluster: str | Column = "cluster", base: int = 0) -> Column:
    """'Cluster i' label; ``base=1`` numbers from one as one of the app charts does."""
    return F.concat(F.lit("Cluster "), (col_(cluster) + F.lit(base)).cast("string"))


def null_count(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def exact_mean(c: str | Column) -> Column:
    """Mean as double from an exact sum (integer or decimal) and a count.

    Summing first in exact arithmetic makes the mean independent of how rows
    are split across tasks, unlike a running double sum.
    """
    c = col_(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
