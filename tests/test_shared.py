import os
import re

import pytest

from tidewise.sources.shared import materialise, scratch, shared_dir


def tables(spark):
    return set(os.listdir(re.sub("^file:/*", "/", shared_dir(spark)) + "/tidewise"))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    first = materialise(spark.range(1))
    before = tables(spark)
    with scratch(spark) as keep:
        a = materialise(spark.range(5))
        with scratch(spark) as inner:
            b = inner(materialise(a.where("id > 1")))
            materialise(b)
        assert b.count() == 3
        c = keep(materialise(b.where("id > 2")))
    assert c.count() == 2 and first.count() == 1 and len(tables(spark) - before) == 1


def test_scratch_tables_go_after_errors(spark):
    materialise(spark.range(1))
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialise(spark.range(5))
        1 / 0
    assert tables(spark) == before
