import math

import pytest

from axisframe.functions import predicate as p

ROWS = [
    (0, 1.5, 0.1, 5, True, float("nan"), 1, "a, b", "10"),
    (1, 2.5, 0.2, None, False, 1.0, -128, "", "x"),
    (2, float("nan"), None, 7, None, None, 127, None, "1d"),
    (3, 100.0, 0.1, 5, True, 3.0, 0, "nan", "1_000"),
]
SCHEMA = "pos long, total double, f float, n int, flag boolean, score double, small tinyint, label string, text string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("total > 2", [1, 3]), ("total != 1.5", [1, 2, 3]), ("total == nan", [2]), ("not total == nan", [0, 1, 3]), ("f == 0.1", [0, 3]), ("f <= 0.1", [0, 3]),
        ("n == 5", [0, 3]), ("n != 5", [1, 2]), ("n == 5.5", []), ("n < 6.5", [0, 3]), ("n == nan", [1]), ("flag == true", [0, 3]), ("flag != TRUE", [1, 2]),
        ("flag < 1", [1]), ("small == 1000", []), ("small < 1000", [0, 1, 2, 3]), ("small > -1000", [0, 1, 2, 3]), ("small >= 1e300", []), ('label == "a, b"', [0]),
        ("label == ''", [1, 2]), ("label == nan", [3]), ("label in (nan, '')", [1, 2, 3]), ("label not in ('')", [0, 3]), ("text > 5", [0]),
        ("total > 1 and (n == 5 or flag == false)", [0, 1, 3]), ("not (n == 5) and total == 2.5", [1]), ("n in 5, 7", [0, 2, 3]), ("n in (5 7)", [0, 2, 3]),
        ("n NOT IN (5)", [1, 2]), ("score < inf", [1, 3]), ("total>2 AND n==5", [3]), ("text == 1_000", [3]), ("score >= nan", []),
    ],
)
def test_selects(frame, expression, want):
    assert sorted(r.pos for r in p.where(frame, expression).collect()) == want


@pytest.mark.parametrize("expression", ["", "n", "n =", "n == ", "(n == 5", "n == 5)", "n ~ 5", "n == 5 n == 6", "n == x", "flag == 2", "n in (5", "label < x", "nothing == 1", "n in (x)", '"n', "n not 5", "n == 1_000"])
def test_refuses(frame, expression):
    with pytest.raises(p.PredicateError):
        p.where(frame, expression)


def test_words_can_be_values_and_columns_are_found():
    tree = p.parse("state in (OR, WA) and not kind == and")
    assert p.columns(tree) == ["state", "kind"]
    assert p.number("-3") == -3 and p.number("1_0") is None and math.isinf(p.number("-inf"))


def test_is_never_null(frame):
    c = p.to_column(p.parse("n == 5 or not flag == true or f < 1"), frame.schema)
    assert frame.select(c.isNull().alias("x")).where("x").count() == 0


def test_prunes_columns(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/f")
    plan = p.where(spark.read.parquet(f"{tmp_path}/f"), "n == 5").select("pos")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pos:bigint,n:int>" in plan
