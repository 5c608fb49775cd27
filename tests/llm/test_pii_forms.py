"""Written forms of phone numbers."""

import pytest
from ledgerwright.llm import pii
from pyspark.sql import functions as F

#: Each form and the number of digits before the permuted ones.
FORMS = {
    "(555) 123-4567": 0, "(555)123-4567": 0, "555-123-4567": 0, "555 123 4567": 0, "+1 (555) 123-4567": 1, "1 (555) 123-4567": 1, "+1 555 123 4567": 1,
    "+15551234567": 1, "+442079460958": 2, "+44 20 7946 0958": 2, "+49 30 901820": 2, "+4930901820": 2, "+33 1 23 45 67 89": 2, "+86 138 1234 5678": 3, "+3545812345": 3,
}
STAY = ["(555) 123", "call (12) 3456", "+1", "a +123 b", "1 + 2222", "x+15", "12345678901", "+1555123456", "+999 12", "(1999) 123-4567"]


def test_written_forms_of_phone_numbers(spark):
    frame = spark.createDataFrame([(v, f"at {v}, or {v}.") for v in [*FORMS, *STAY]], "v string, text string")
    got = {r.v: r for r in pii.pseudonymize(frame, "k", count_col="n").collect()}
    for v in STAY:
        assert (got[v].text, got[v].n) == (f"at {v}, or {v}.", 0)
    for v, code in FORMS.items():
        a, b = got[v].text[3:-1].split(", or ")
        digits = lambda s: "".join(c for c in s if c.isdigit())
        assert a == b != v and got[v].n == 2 and [c.isdigit() for c in a] == [c.isdigit() for c in v], v
        assert digits(a)[:code] == digits(v)[:code] and [c for c in a if not c.isdigit()] == [c for c in v if not c.isdigit()], v


@pytest.mark.parametrize("key", ["k", "other"])
def test_phone_forms_are_permuted(spark, key):
    there = spark.createDataFrame([(v,) for v in FORMS], "v string").select("v", pii.pseudonym(F.col("v"), key).alias("p"))
    assert there.where(pii.pseudonym(F.col("p"), key, inverse=True) != F.col("v")).count() == 0
