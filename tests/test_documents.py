"""Labels of pages on literal boxes."""

from finloom.operators import documents as D

BOX = "page long, box long, x1 long, y1 long, x2 long, y2 long"


def test_nearest_labels_meet_by_page_without_broadcasts(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 2, 2), (1, 2, 500, 500, 502, 502), (2, 3, 0, 0, 2, 2), (3, 4, 0, 0, 2, 2)], BOX)
    labels = spark.createDataFrame([(1, 11, 4, 0, 6, 2), (1, 10, 0, 4, 2, 6), (2, 12, 300, 0, 302, 2)], BOX)
    got = D.nearest_label(boxes, labels)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 64, 10), (1, 2, 992**2 + 1000**2, 10), (2, 3, 600**2, 12)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
