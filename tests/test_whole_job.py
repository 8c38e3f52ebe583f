"""Cases in which an operator once did less than its whole job."""

import random
import re

from timeloom import plans
from timeloom.operators import frames


def test_frames_are_not_ordered_in_one_task(spark):
    ids = sorted(random.Random(3).sample(range(100_000), 500))
    hist = spark.createDataFrame([(i, b, 1 + (i + b) % 5) for i in ids for b in range(2)], "frame_id long, bin long, n long")
    made = frames.shot_distances(hist)
    assert sorted((r.frame_id, r.prev_id) for r in made.collect()) == list(zip(ids[1:], ids))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lag\(frame_id[^)]*\) windowspecdefinition\(frame_id", plan)


def test_ranges_to_intersect_are_made_once(spark):
    plan = plans.queries()["c6_intersect_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "start_ms" in plan
