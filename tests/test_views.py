"""Views for training keep every accepted step."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tripmill.plans.models import clean_steps

SF = "/root/testdata/sf0.001"
COPIES = {"aligned_variants": 1, "view_classification": 1, "view_denoising": 2, "view_imputation": 2, "view_unmasked": 2, "view_dual_branch": 1}


def test_views_have_every_accepted_step(spark):
    queries = entry.queries()
    steps = clean_steps(spark, SF).select("trj_id", "seg_id", "pos").toPandas()
    for name, copies in COPIES.items():
        places = queries[name](spark, SF).groupBy("trj_id", "seg_id", "pos").agg(F.count(F.lit(1)).alias("n")).toPandas()
        assert len(places) == len(steps) and set(places["n"]) == {copies}, name
