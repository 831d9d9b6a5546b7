"""Search by trigrams against a scan by the same patterns."""

import random

import pytest
from pyspark.sql import functions as F

from playtally import functions as fn
from playtally.operators import text_index
from tests.conftest import plan_of

PIECES = ["a", "B", "ab", "Abc", "%", "_", "\\", "é", "É", "İ", "ß", "K", "Σ", "x y", "1", "12", "'", ""]


def test_searches_equal_scans(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(9))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame(
        [(i, t, rng.choice(texts)) for i, t in enumerate(texts)], "id long, a string, b string"
    ).repartition(4)
    index = text_index.build_index(rows, "id", ["a", "b"])
    patterns = ["%abc%", "%a_c%", "abc%12", "%É1%", "%kab%", "%Kab%", "%ab\\%%", "%x y%", "%", "%ßabc%", "%i̇ab%"]
    plain = [x for x in texts if x and "\\" not in x]
    patterns += [f"%{rng.choice(plain)}%" for _ in range(8)]
    for pattern in patterns:
        other = rng.choice(patterns)
        one = F.coalesce(fn.like(F.col("a"), pattern), F.lit(False))
        two = F.coalesce(fn.like(F.col("b"), other), F.lit(False))
        ids = lambda df: sorted(r.id for r in df.select("id").collect())
        assert ids(text_index.search(rows, index, "id", {"a": pattern})) == ids(rows.where(one))
        both = text_index.search(rows, index, "id", {"a": pattern, "b": other})
        assert ids(both) == ids(rows.where(one & two))
        either = text_index.search(rows, index, "id", {"a": pattern, "b": other}, every=False)
        assert ids(either) == ids(rows.where(one | two))


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        ("%ab%", []), ("%AbC%", ["abc"]), ("abcd_ef%", ["abc", "bcd"]), ("ab\\_c", ["ab_", "b_c"]),
        ("ab\\", []), ("abéabc", ["abc"]), ("", []),
    ],
)
def test_trigrams_of_patterns(pattern, wanted):
    assert text_index.pattern_trigrams(pattern) == wanted


def test_a_search_reads_the_trigrams_of_its_pattern(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("a"))
    text_index.write_index(text_index.build_index(rows, "id", ["a"]), str(tmp_path / "index"))
    index = text_index.read_index(spark, str(tmp_path / "index"))
    found = text_index.search(rows, index, "id", {"a": "%e 199%"})
    assert sorted(r.id for r in found.collect()) == [199, *range(1990, 2000)]
    scan = next(b for b in plan_of(found).split("\n\n") if "index" in b and "PushedFilters" in b)
    assert "In(trigram" in scan
    # Too short for the index: a scan, with the same result.
    short = text_index.search(rows, index, "id", {"a": "%99%"})
    assert "index" not in plan_of(short) and short.count() == rows.where("a LIKE '%99%'").count()
