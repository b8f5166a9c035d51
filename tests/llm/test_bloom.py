"""Maps and counts merged over many small tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.language import CELLS, train


@pytest.mark.parametrize("fan", [1, 3, 256])
def test_a_map_of_many_tasks_holds_every_key(spark, fan):
    keys = spark.range(0, 5_000, 1, 40).select(F.when(F.col("id") % 7 != 0, F.col("id") * 1_000_003).alias("k"))
    bits = bloom.bit_map(keys, fan)
    assert (bits == bloom.bit_map(keys.coalesce(1))).all()
    ids = np.arange(5_000)
    held = bloom.may_hold(bits, ids * 1_000_003)
    assert held[ids % 7 != 0].all() and held[ids % 7 == 0].mean() < 0.01


def test_an_empty_table_has_an_empty_map(spark):
    assert not bloom.bit_map(spark.range(0).select("id")).any()


@pytest.mark.parametrize("fan", [1, 4])
def test_language_counts_of_many_tasks_add_up(spark, fan):
    texts = {"de": "der Hund und die Katze %d", "en": "the dog and the cat %d"}
    rows = spark.createDataFrame([(lang, t % i) for lang, t in texts.items() for i in range(60)], "lang string, text string")
    many, one = train(rows.repartition(30), fan), train(rows.coalesce(1))
    assert many.names == one.names == ["de", "en"] and many.log_p.shape == (CELLS, 2)
    np.testing.assert_array_equal(many.log_p, one.log_p)
