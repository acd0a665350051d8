"""Author lists: what is accepted, refused and how it is written."""

import pytest
from pyspark.sql import functions as F

from helixmill.functions import text as X

ACCEPTED = [
    ("Xi, L.; Yu, X.;", "Xi, L.; Yu, X."), ("Xi,L;Yu,X.;", "Xi, L.; Yu, X."), ("Xi,;Yu,X.;", "Xi, ; Yu, X."), ("Xi, ;Yu,X.", "Xi, ; Yu, X."), ("Xi,;", "Xi,"), ("Xi,", "Xi,"),
    ("Smith, Anna Maria; Perez, Jose X.;", "Smith, Anna Maria; Perez, Jose X."), ("Smith,Anna Maria;Perez,Jose X;", "Smith, Anna Maria; Perez, Jose X."), ("de souza, a.", "de souza, A."), ("McGregor, Ewan", "McGregor, Ewan"),
    ("'t Hooft, Gerard", "'t Hooft, Gerard"), ("Tandoc, A. 3rd", "Tandoc, A. 3rd"), ("Smith, John II", "Smith, John II"), ("Doe, A.B.C.", "Doe, A. B. C."), ("Lee, J D", "Lee, J. D."), ("Xu, X.L", "Xu, X. L."), ("SMITH, AMY", "SMITH, AMY"),
    ("Smith, AD", "Smith, A. D."), ("Black, W. C. IV", "Black, W. C. IV"), ("Dantas, Pedro HLF", "Dantas, Pedro H. L. F."), ("Diclaro, J.W.II", "Diclaro, J. W. II"), ("Ramirez, II II", "Ramirez, I. I. II"), ("Çelik, Ö.", "Çelik, Ö."),
]
REFUSED = [";", ",;", " ,;", ",X.;Yu,X.", ",;Yu,X.", "Anna Maria Smith; Jose X. Perez", "Anna Maria Smith;", "Anna Maria Smith", "Smith9, Anna;", "Anna Smith, Cameron Tucker, and Jose Perez", "Count4th, EwanMcGregor, Count4th", "Smith, A; ;Doe, B"]


@pytest.mark.parametrize(("given", "want"), ACCEPTED)
def test_accepted(given, want):
    assert X.authors_accepted(given) and X.format_authors(given) == want


@pytest.mark.parametrize("given", REFUSED)
def test_refused(given):
    assert not X.authors_accepted(given)


def test_helpers():
    assert X.invalid_authors("Smith, Anna; Invalid Name; BadFormat123; Perez, Tom J.; 12345; NoComma") == ["Invalid Name", "BadFormat123", "12345", "NoComma"]
    assert X.authors_look_wrong("Smith, Anna, Perez, Tom") and not X.authors_look_wrong("Smith, Anna; Perez, Tom") and not X.authors_look_wrong("Smith, Anna M.")
    assert X.holds_conjunction("Smith, Anna; Perez, Tom J. and Xu X. L.") and not X.holds_conjunction("Anderson, A.")
    assert X.non_latin("Петров, A") and not X.non_latin("Łukasz, É")


def test_column(spark):
    rows = [("Smith, John II; Doe, A.B.C.",), ("Петров, А.",), ("a; b; c; d; e",), ("Perez, Tom J. and Xu X. L.",), (None,), ("  ",)]
    got = spark.createDataFrame(rows, "a string").select(X.check_authors(F.col("a")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [
        ("Smith, John II; Doe, A. B. C.", None, []), (None, "non_latin", []), (None, "invalid:a; b; c and 2 others", []),
        ("Perez, Tom J. and Xu X. L.", None, ["separators", "conjunction"]), (None, None, []), (None, None, []),
    ]


def test_flat_file_line():
    assert X.embl_authors("Smith, Anna Maria; Pérez, José X.;") == "Smith A.M., Perez J.X."
