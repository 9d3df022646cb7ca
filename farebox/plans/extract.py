"""Row extracts as CSV text that a spreadsheet cannot mistake for formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.operators import questions
from farebox.operators.filters import TripFilter
from farebox.plans.route import TripStore

# Fixed value: the characters that start a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def safe_text(text: Column) -> Column:
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(column: str, kind: T.DataType) -> Column:
    """Text of one cell: NULL is empty, numbers are left as they are, text is made safe."""
    value = F.col(f"`{column}`")
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        fraction = F.date_format(value, "SSSSSS")
        text = F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    elif isinstance(kind, T.ArrayType):
        text = safe_text(F.array_join(value.cast("array<string>"), ";"))
    elif isinstance(kind, T.StringType):
        text = safe_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("")).alias(column)


def csv_safe(df: DataFrame) -> DataFrame:
    return df.select(*[csv_cell(f.name, f.dataType) for f in df.schema.fields])


def extract(
    store: TripStore,
    f: TripFilter = questions.ALL,
    columns: Sequence[str] | None = None,
    max_rows: int | None = None,
    sort: str = "pickup_datetime",
    descending: bool = True,
    quality: str = "all",
    flag: str | None = None,
) -> DataFrame:
    """The rows of a selection in order, sorted by ranges over the cluster; the first `max_rows` if that is given."""
    chosen = list(columns or questions.ROW_COLUMNS)
    unknown = set(chosen) - set(questions.ROW_COLUMNS)
    if unknown:
        raise KeyError(f"unknown columns: {sorted(unknown)}")
    rows = questions.scoped_rows(store, f, quality, flag).select(*questions.ROW_COLUMNS)
    return questions.at_most(rows.orderBy(*questions.row_order(sort, descending)), max_rows).select(*chosen)


def write_extract(store: TripStore, path: str, f: TripFilter = questions.ALL, **options) -> dict[str, int | bool]:
    """Write the extract as CSV, a part per range; reports matched and exported rows and whether a limit cut it."""
    rows = extract(store, f, **options)
    scope = {k: options[k] for k in ("quality", "flag") if k in options}
    matched = questions.explore_count(store, f, **scope).first().total
    exported = min(matched, options.get("max_rows") or matched)
    csv_safe(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return {"matched": matched, "exported": exported, "truncated": exported < matched}
