import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.functions import similarity, text


@settings(deadline=None, max_examples=200)
@given(st.text("abcé😀", max_size=12), st.text("abcé😀", max_size=12))
def test_common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common_length(a, b) == table[-1][-1]


def test_native_and_arrow_ratio_agree(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(0, 9)))
    df = spark.createDataFrame([(word(), word()) for _ in range(300)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(similarity.indel_ratio(a, b).alias("x"), similarity.indel_ratio_native(a, b).alias("y"), similarity.could_reach(a, b, 60.0).alias("c")).collect()
    assert all(abs(r.x - r.y) < 1e-12 for r in rows)
    assert all(r.c for r in rows if r.x >= 60)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


def test_scalars(spark):
    assert one(spark, "N. D.", text.normalize_year) == "nd"
    assert one(spark, "2020a", text.normalize_year) == "2020"
    assert one(spark, "In  Press", text.normalize_year) == "inpress"
    assert one(spark, "J.K. Smith, M Nilsson & O’Brien’s et al.", text.split_authors) == ["Smith", "Nilsson", "O’Brien"]
    assert one(spark, "van der Berg", text.first_surname_key) == "berg"
    assert one(spark, "van de", text.first_surname_key) == "van"
    assert one(spark, "Le Velly", text.strip_particles) == "Velly"
    assert one(spark, "van", text.strip_particles) == "van"
    assert one(spark, None, text.strip_particles) is None
    assert [tuple(s) for s in one(spark, "3, 5-3, 7–9, x", text.number_spans)] == [(3, 3), (7, 9)]
    spans = one(spark, "1-999999999", text.number_spans)
    assert spans[0].low == 1 and spans[-1].high == 999_999_999 and sum(s.high - s.low + 1 for s in spans) == 999_999_999
    assert all(b.low == a.high + 1 for a, b in zip(spans, spans[1:], strict=False)) and max(s.high - s.low for s in spans) < text.SPAN
    assert one(spark, ", sec. 2", text.locator)["label"] == "section"


def test_sql_names(spark):
    from citeweave.functions import register

    register(spark)
    row = spark.sql("SELECT indel_ratio('smith', 'smyth') AS r, token_sort_ratio('a bc', 'bc a') AS t, size(parse_paragraph('(Smith, 2020)')) AS n").first()
    assert (row.r, row.t, row.n) == (80.0, 100.0, 1)
