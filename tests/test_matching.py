from gatelens.operators import matching

BOX = "frame_id long, det_id long, x1 int, y1 int, x2 int, y2 int, conf double, ch string"
TRUTH = "frame_id long, truth_id long, x1 int, y1 int, x2 int, y2 int, ch string"


def test_a_missing_character_shifts_no_other(spark):
    """Truth ABC, boxes B and X over B and C: only C as X is confused; by places in the string all would be."""
    at = lambda i: (20 * i, 0, 20 * i + 10, 10)
    truth = spark.createDataFrame([(1, i, *at(i), c) for i, c in enumerate("ABC")] + [(2, 0, *at(0), None)], TRUTH)
    boxes = spark.createDataFrame([(1, 0, *at(1), 0.9, "B"), (1, 1, *at(2), 0.8, "X"), (2, 0, *at(0), 0.9, "A")], BOX)
    assert [tuple(r) for r in matching.confusion_counts(boxes, truth).collect()] == [("C", "X", 1)]


def test_each_truth_counts_once_and_the_most_frequent_come_first(spark):
    box = (0, 0, 10, 10)
    truth = spark.createDataFrame([(f, 0, *box, "O") for f in range(5)], TRUTH)
    near = (0, 0, 10, 9)
    boxes = spark.createDataFrame([(f, 0, *box, 0.5, "0" if f else "Q") for f in range(5)] + [(f, 1, *near, 0.9, "D") for f in range(5)], BOX)
    assert [tuple(r) for r in matching.confusion_counts(boxes, truth).collect()] == [("O", "0", 4), ("O", "Q", 1)]
    assert matching.confusion_counts(boxes, truth, most=1).count() == 1
    assert matching.confusion_counts(boxes.limit(0), truth).count() == 0


def test_characters_are_matched_by_one_join(spark):
    """Two boxes on one truth, a free box, a frame with truths only and rows without a frame, which match nothing."""
    at = lambda i: (20 * i, 0, 20 * i + 10, 10)
    boxes = spark.createDataFrame([(1, 0, *at(0), 0.9, "A"), (1, 1, 0, 0, 10, 9, 0.9, "A"), (1, 2, *at(1), 0.9, "B"), (1, 3, *at(5), 0.9, None), (None, 0, *at(0), 0.9, "A"), (3, 0, *at(0), 0.9, None)], BOX)
    truth = spark.createDataFrame([(1, 0, *at(0), "A"), (1, 1, *at(1), "C"), (2, 0, *at(0), "A"), (None, 0, *at(0), "A"), (3, 0, *at(0), None)], TRUTH)
    found = matching.char_eval(boxes, truth)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 1, 2, 0, 1, False), (2, 0, 0, 1, 0, False), (3, 1, 0, 0, 0, True), (None, 0, 1, 1, 0, False)], key=repr)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
