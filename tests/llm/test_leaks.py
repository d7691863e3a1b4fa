"""Tests of leaked passages (problem 7)."""

from cloudloom.llm import leaks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_leaks_of_passages_that_share_their_words(spark):
    shared = "the heavy infirmary stood beyond the handsome market near the old granary"
    items = spark.createDataFrame([(k, f"Number {w} wrote that {shared} of {w}") for k, w in enumerate(("Ulmir", "Wirnrath", "Karling", "Brentig", "Petstad"))], "item_id bigint, passage string")
    words = shared.split()
    docs = [(1, "x " + shared + " y"), (2, "x " + " ".join(words[:9]) + " y"), (3, "\n".join([" ".join(words[:5]), " ".join(words[5:8]), " ".join(words[8:])])), (4, " ".join(words[:9]) + "\nthe old")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted((i, k) for i in (1, 3, 4) for k in range(5))
    assert rows(leaks.leaked(d, items)) == want
    assert rows(leaks.leaked(d, items, block_chars=100)) == want


def test_near_equal_passages_do_not_hide_each_other(spark):
    """Six passages that differ in one word: a page with 14 words of them gives six pairs, whatever the blocks."""
    base = "under the quiet arches of the covered market a patient {} sold copper kettles and painted clocks to every passing traveller"
    items = spark.createDataFrame([(k, base.format(w)) for k, w in enumerate(("widow", "baker", "clerk", "sailor", "tinker", "farmer"))], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, "news of the day\ncopper kettles and painted\nclocks to every passing traveller\nmore news"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(leaks.leaked(d, items)) == []  # nine words only
    d = spark.createDataFrame([(1, "x\n" + " ".join(base.split()[:9]) + "\n" + "sold copper kettles and painted clocks to every passing traveller")], "doc_id bigint, text string")
    want = [(1, k) for k in range(6)]
    assert rows(leaks.leaked(d, items)) == want
    assert rows(leaks.leaked(d, items, block_chars=150)) == want


def test_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "石蓮町の学校は昨日の午後に静かな港で新しい船を買った"), (2, None), (3, "")], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, "前の文。石蓮町の学校は昨日の午後に\n静かな港で新しい船を買った。"), (2, "石蓮町の学校は")], "doc_id bigint, text string")
    assert rows(leaks.leaked(d, items)) == [(1, 1)]
