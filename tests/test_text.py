import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.functions.helpers import embedder, nfkc, nfkc_where_needed
from mnemoframe.plans import text_queries


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [tuple(r)[1:] for r in df.select("i", *(c(*map(F.col, names)).alias(f"r{i}") for i, c in enumerate(columns))).orderBy("i").collect()]


def test_terms(spark):
    rows = [("three trips ordered",), ("the of and",), ("what did I buy two weeks ago",), ("I like it",), ("SessionConsolidator를",), (None,)]
    got = [set(r[0]) for r in values(spark, rows, T.content_terms)]
    assert got[0] == {"three", "trips", "trip", "ordered", "order"} and got[1] == set() and "buy" in got[2] and not {"ago", "weeks"} & got[2]
    assert "like" in got[3] and "sessionconsolidator" in got[4] and got[5] == set()


R = 19509  # 2023-06-01


@pytest.mark.parametrize(
    ("question", "want"),
    [("two weeks ago", (-17, -11)), ("past three months", (-90, 0)), ("last Saturday", (-6, -4)), ("yesterday", (-2, 0)), ("last name", None), ("a couple of days ago", (-3, -1)), ("last weekend", (-6, -3)), ("this week", (-7, 0)), ("last year", (-730, -182))],
)
def test_windows(spark, question, want):
    df = spark.createDataFrame([(question, "2023/06/01 (Thu) 12:00"), (question, "no date")], "q string, d string").withColumn("day", T.epoch_day(F.col("d")))
    start, end = T.temporal_window(F.col("q"), F.col("day"))
    good, bad = df.select("day", start.alias("s"), end.alias("e"), T.has_temporal_intent(F.col("q")).alias("intent")).collect()
    assert good.day == R and (good.s, good.e) == (tuple(R + x for x in want) if want else (None, None))
    assert (bad.day, bad.s) == (None, None) and good.intent == (want is not None)


def test_dates_roll_over(spark):
    rows = [("[date: 2023/02/31] x",), ("x [date: 2023/02/01]",), ("[date: 2023/13/01",), (None,)]
    assert values(spark, rows, T.epoch_day, T.body_epoch_day) == [(19419, 19419), (19389, None), (19723, 19723), (None, None)]


def test_scalars(spark):
    rows = [("Hello, World!",), ("COM1",), ("!!!",), ("한글 파일",), ("a" * 100,), ("x" * 79 + "--yy",)]
    assert [r[0] for r in values(spark, rows, T.slug)] == ["hello-world", "com1-x", "unnamed", "한글-파일", "a" * 80, "x" * 79]
    assert [r[0] for r in values(spark, [("",), ("abcd",), ("abcde",), (None,)], T.estimate_tokens)] == [0, 1, 2, 0]
    assert values(spark, [("One. Two!  Three\n\nfour? ",)], T.split_sentences) == [(["One.", "Two!", "Three", "four?"],)]
    assert [r[0] for r in values(spark, [("ééé",), ("ab",)], lambda c: T.truncate_bytes(c, 5, "..."))] == ["éé...", "ab"]
    assert values(spark, [("<!-- claim:cl-a1 --> x <!--claim:cl-b-->",)], T.claim_ids) == [(["cl-a1", "cl-b"],)]
    assert values(spark, [("{bad",), ('{"a": {"b": 2}}',)], lambda c: T.safe_json(c, "$.a.b")) == [(None,), ("2",)]


def test_split_matches_fnv(spark):
    ids = ["", "a", "q_17", "gpt4_abs", "é한"]

    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return "dev" if h % 2 == 0 else "test"

    assert [r[0] for r in values(spark, [(i,) for i in ids], T.split_of)] == [fnv(i) for i in ids]


def test_answers(spark):
    rows = [("Business Administration", "business administration"), ("", ""), ("x", ""), ("a b b c", "b b d")]
    assert [r[0] for r in values(spark, rows, T.token_f1)] == pytest.approx([1, 1, 0, 4 / 7])
    assert values(spark, [("Café-au-lait", "")], lambda a, b: T.normalize_answer(a)) == [("café au lait",)]


def test_nfkc(spark):
    rows = [("ﬁne ①",), ("plain",), (None,)]
    want = [None if t is None else unicodedata.normalize("NFKC", t) for (t,) in rows]
    assert [r[0] for r in values(spark, rows, nfkc)] == want == [r[0] for r in values(spark, rows, nfkc_where_needed)]
    (a, b) = (r[0] for r in values(spark, [("Note", "Two  Words "), ("Note", "two words")], T.content_hash))
    assert a == b


def test_embedding(spark):
    texts = ["contradiction detection report", "contradictions detected reporting", "banana smoothie recipe", "", "   ", "!!! ??", "a", None]
    v = [np.array(r[0]) for r in values(spark, [(t,) for t in texts], embedder())]
    assert [float(np.linalg.norm(x)) for x in v] == pytest.approx([1, 1, 1, 0, 0, 0, 1, 0], abs=1e-6)
    assert v[0] @ v[1] > v[0] @ v[2]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.5**0.5, 0])
    with pytest.raises(Exception, match="different dimensions"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(T.cosine(F.col("a"), F.col("b"))).collect()


def test_snippet(spark):
    df = spark.createDataFrame([("one two three Four five", ["four"]), ("nothing here", ["x"])], "b string, t array<string>")
    assert [r[0] for r in df.select(T.snippet(F.col("b"), F.col("t"), 2)).collect()] == ["... [Four] five", "nothing here"]


def test_slug_query_keeps_reserved_names_and_nulls(spark, tmp_path):
    rows = [(1, "Con", "es", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, "-" * 90, "en", "s"), (5, "Lpt1!", "en", "s"), (6, "A, b", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.slug for r in text_queries.f10_slug(spark, str(tmp_path)).collect()}
    assert out == {1: "con", 2: None, 3: "unnamed", 4: "unnamed", 5: "lpt1", 6: "a-b"}
