"""The five views that questions about records are answered from, and who may read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the views, and the groups of which a caller needs one (none: any group will do).
VIEWS = {
    "customers": ("customer_id name industry tier sla_hours region account_manager_id created_on", None),
    "employee_directory": ("employee_id full_name email department title manager_id location hire_date", None),
    "shipments": ("shipment_id customer_id origin destination mode status weight_kg booked_at promised_at delivered_at is_late", None),
    "invoices": ("invoice_id customer_id shipment_id amount_usd issued_on due_on paid_on status", ["finance", "sales", "exec"]),
    "employee_compensation": ("employee_id base_salary_usd bonus_pct pay_band effective_date", ["hr", "exec"]),
}


def is_late(delivered: Column, promised: Column) -> Column:
    """Whether something came after its promise; what hasn't come isn't late, nor is what came with no promise known null."""
    return delivered.isNotNull() & (delivered > promised)


def analytics_views(tables: dict[str, DataFrame], groups: list[str]) -> dict[str, tuple[DataFrame, list[str] | None]]:
    """Views by name with the groups that may read them, as ``sqlguard.Caller`` takes them, over ``tables`` (customers, employees, shipments, invoices, employee_compensation).

    A view with groups holds no rows for a caller without one of them: the filter is part of the view, so it holds wherever the view is used.
    """
    source = {"employee_directory": "employees"}
    out = {}
    for name, (columns, need) in VIEWS.items():
        df = tables[source.get(name, name)]
        if name == "shipments":
            df = df.withColumn("is_late", is_late(F.col("delivered_at"), F.col("promised_at")))
        df = df.select(*columns.split())
        if need is not None:
            df = df.filter(F.arrays_overlap(F.array(*map(F.lit, need)), F.array(*map(F.lit, groups)).cast("array<string>")))
        out[name] = (df, need)
    return out
