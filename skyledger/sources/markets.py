"""Market listings: question text to bucket bounds and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:\.\d+)?)\s*°?\s*[FC]?"
FORMS = {
    "between": rf"(?i)\b(?:between\s+)?{NUMBER}\s*(?:-|to|and)\s*{NUMBER}\s*(?:on\b|\?|$)",
    "higher": rf"(?i){NUMBER}\s+or\s+(?:higher|above|more)",
    "below": rf"(?i){NUMBER}\s+or\s+(?:below|lower|less)",
    "exact": rf"(?i)\bbe\s+{NUMBER}\s*(?:on\b|\?|$)",
}
DATE = r"(?i)\bon\s+([A-Z][a-z]+ \d{1,2}, \d{4})"


def parse_markets(df: DataFrame, text: str) -> DataFrame:
    """Add lower, upper, unit and market_date; a question that fits no form keeps null bounds and says so in `parse_reason`."""
    q = F.col(text)

    def part(form: str, index: int):
        return F.when(q.rlike(FORMS[form]), F.regexp_extract(q, FORMS[form], index).try_cast("double"))
    tail_high, tail_low = q.rlike(FORMS["higher"]), q.rlike(FORMS["below"])
    exact = part("exact", 1)
    lower = F.when(tail_high, part("higher", 1)).when(tail_low, None).otherwise(F.coalesce(part("between", 1), exact))
    upper = F.when(tail_low, part("below", 1)).when(tail_high, None).otherwise(F.coalesce(part("between", 2), exact))
    unit = F.when(q.rlike(r"\d\s*°?\s*C\b"), "C").otherwise("F")
    date = F.try_to_date(F.regexp_extract(q, DATE, 1), "MMMM d, yyyy")
    return df.withColumns({"lower": lower, "upper": upper, "unit": unit, "market_date": date}).withColumn(
        "parse_reason", F.when(F.col("lower").isNull() & F.col("upper").isNull(), "unparsed_bucket").when(F.col("market_date").isNull(), "unparsed_date"))
