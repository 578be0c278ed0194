"""Held-out rows alone get the novelty flags they have among all rows."""

from __future__ import annotations

from pulsegate import columns as C
from pulsegate.operators.splits import annotate_novelty
from pulsegate.plans.study import SPLITS, Study


def test_reference_rows_from_another_table(spark):
    kinds = f"{C.SUBJECT} long, {C.SPLIT} string"
    seen, last = SPLITS.reference[0], SPLITS.evaluation
    df = spark.createDataFrame([(1, seen), (1, last), (2, last), (None, seen), (None, last), (3, seen), (3, last)], kinds)
    held = df.where(f"{C.SPLIT} = '{last}'")
    whole = annotate_novelty(df, SPLITS).where(f"{C.SPLIT} = '{last}'")
    alone = annotate_novelty(held, SPLITS, reference=df)
    assert sorted(map(str, whole.collect())) == sorted(map(str, alone.collect()))


def test_marks_of_one_split(spark):
    s = Study(spark, "/root/testdata/sf0.001")
    alone = s.mark(s.split("test"))
    whole = s.marked.where(f"{C.SPLIT} = 'test'")
    assert alone.count() > 0 and alone.exceptAll(whole).count() == 0 == whole.exceptAll(alone).count()
