from gatelens.operators import text

CHARS = "event_id long, pos long, ch string, conf double"
READS = "event_id long, base string, pred string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_wrong_characters_with_their_confidence(spark):
    chars = [(1, i + 1, c, conf) for i, (c, conf) in enumerate(zip("3OA1", (0.9, 0.2, 0.2, None)))]
    chars += [(2, i + 1, c, 0.5) for i, c in enumerate("30A2")]  # right
    chars += [(3, 1, "X", None), (3, None, "Y", 0.1), (3, 2, None, 0.1)]
    chars = spark.createDataFrame(chars, CHARS).repartition(3)
    reads = spark.createDataFrame([(1, "30A", "3OA1"), (2, "30A2", "30A2"), (3, "Z", "X"), (4, None, "Q"), (5, "A", "")], READS)
    got = rows(text.char_confidence(chars, reads).where("event_id = 1"))
    # "1" stands beyond the true text; the second place is mended to a digit, and so are the last four
    assert got == [(1, 1, "3", "3", "3", False, False, 0.9), (1, 2, "O", "0", "0", True, False, 0.2), (1, 3, "A", "4", "A", True, True, 0.2), (1, 4, "1", "1", None, False, True, None)]
    assert {r[0] for r in rows(text.char_confidence(chars, reads))} == {1, 3}
    assert rows(text.weakest_chars(chars, reads)) == [(1, 2, "O", 0.2, 0.433333)]


def test_string_figures_with_and_without_confidence(spark):
    reads = spark.createDataFrame([(1, "30A-12345", "30A-12345"), (2, "30A-12345", "30A-1234"), (3, "nothing", "30A-12345")], READS)
    r = text.string_eval(reads).first()
    assert (r.n, r.exact_raw, r.pass_truth, r.mean_conf) == (2, 1, 2, None)
    conf = reads.selectExpr("*", "CASE event_id WHEN 1 THEN 0.5D WHEN 3 THEN 0.1D END AS conf")
    assert text.string_eval(conf).first().mean_conf == 0.5


def test_no_characters(spark):
    empty, reads = spark.createDataFrame([], CHARS), spark.createDataFrame([], READS)
    assert text.char_confidence(empty, reads).count() == 0 and text.weakest_chars(empty, reads).count() == 0
    assert text.string_eval(reads).first().n == 0
