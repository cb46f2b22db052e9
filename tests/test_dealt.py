import random
from itertools import accumulate

from pyspark.sql import functions as F

from tidewell.operators.dealt import pairs_within, running_sum
from tidewell.operators.movement import near_words


def test_pairs_of_a_large_key_meet_in_tiles(spark):
    rng = random.Random(1)
    rows = [("hot", f"p{i}", i) for i in range(300)] + [(f"k{rng.randrange(20)}", f"q{i}", i) for i in range(100)] + [(None, "x", 1), (None, "y", 2)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "key string, item string, n int"), "key", "item", 16).select("key", "item", "other_item", "n", "other_n").collect()]
    want = {(a[0], a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1]}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_task_holds_a_query_of_twenty_thousand_pages(spark):
    rows = spark.range(20_000).select(F.lit("q").alias("key"), F.concat(F.lit("p"), "id").alias("item"), F.lit(1).alias("n"))
    met = pairs_within(rows, "key", "item").select("key", "item", "other_item")
    # What one place holds: rows of two tiles by tile.
    assert met.rdd.getNumPartitions() > 1
    assert met.count() == 20_000 * 19_999 // 2


def test_running_sums_without_one_ordered_task(spark):
    rng = random.Random(2)
    rows = [(float(o), rng.randrange(9)) for o in rng.sample(range(10_000), 3000)]
    summed = running_sum(spark.createDataFrame(rows, "o double, n int").repartition(7), "o", "n", "before")
    ordered = sorted(rows)
    assert [tuple(r) for r in summed.orderBy("o").collect()] == [(o, n, b) for (o, n), b in zip(ordered, [0, *accumulate(n for _, n in ordered)], strict=False)]
    assert running_sum(spark.createDataFrame([], "o double, n int"), "o", "n", "before").collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def some_words(rng, n):
    words = []
    for _ in range(n):
        word = rng.choice(["how to ", "how to make a ", "", "a"]) + "".join(rng.choice("abcd ") for _ in range(rng.randrange(9)))
        words.append(word)
        if rng.random() < 0.6:
            at = rng.randrange(len(word) + 1)
            words.append(word[:at] + rng.choice("xa") + word[at + rng.randrange(2) :])
    return words


def test_common_beginnings_are_split_and_lose_no_pair(spark):
    rng = random.Random(4)
    left, right = some_words(rng, 150), some_words(rng, 150) + ["", "ab"]
    want = {(x, y) for x in left for y in right if x != y and edits(x, y) <= 2}
    frames = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(y,) for y in right], "y string")
    for heavy in (0, 50, 10**9):
        got = [tuple(r) for r in near_words(*frames, heavy=heavy).collect()]
        assert len(got) == len(set(got)) and set(got) == want, heavy
