from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.text import cut, redact
from millrace.operators.models import hashed_vector

CASES = [
    # what is found
    ("reply to mira_k+orders@shop.test.org, thanks", "reply to [EMAIL], thanks"),
    ("two: a@b.io;c.d@e-f.net", "two: [EMAIL];[EMAIL]"),
    ("ring 030.1234.5678 or +49 (30) 1234 5678.", "ring [PHONE] or [PHONE]."),
    ("paid by 6011-1111-1111-1117, or 378282246310005", "paid by [CARD], or [CARD]"),
    ("his number is 078-05-1120!", "his number is [SSN]!"),
    ("hosts 10.0.0.255, 255.255.255.0 and fe80:0:0:0:0:0:0:1", "hosts [IP], [IP] and [IP]"),
    ("twice 078-05-1120 078-05-1120", "twice [SSN] [SSN]"),
    # what looks alike and is not
    ("paid by 6011-1111-1111-1118", "paid by 6011-1111-1111-1118"),  # fails the checksum and has too many digits to call
    ("invoice 4815162342108", "invoice 4815162342108"),  # no separator
    ("due 2031-11-05 09:15", "due 2031-11-05 09:15"),
    ("a crowd of 3 500 000", "a crowd of 3 500 000"),
    ("release 300.4.5.6", "release 300.4.5.6"),
    ("nobody@nowhere", "nobody@nowhere"),
    ("", ""),
    (None, None),
]


def test_redaction(spark):
    df = spark.createDataFrame([(i, a, "a@b.com") for i, (a, _) in enumerate(CASES)], "id int, note string, other string")
    got = redact(df, ["note"]).orderBy("id").collect()
    assert [r.note for r in got] == [b for _, b in CASES] and got[0].other == "a@b.com"


def test_hashes_denote_the_same_thing(spark):
    df = spark.createDataFrame([("3782 822463 10005 Me@there.org",), ("378282246310005 me@THERE.org",)], "t string")
    a, b = (r.t for r in redact(df, ["t"], hashed=True).collect())
    assert a == b and a.startswith("[CARD:") and "[EMAIL:" in a


def test_chunks():
    assert cut("0123456789abcdef", 7, 3) == ["0123456", "456789a", "89abcde", "cdef"]  # no gap: by length, with the overlap
    assert cut("one two three four", 9, 0) == ["one two", "three", "four"]  # at gaps
    assert cut("begin" + "\t \n" * 9 + "end", 8, 3)[0].startswith("begin") and cut("begin" + " " * 27 + "end", 8, 3) == ["begin", "end"]
    assert cut(None, 3, 0) == cut("", 3, 0) == cut("  ", 3, 0) == [] and cut("whole", 5, 4) == ["whole"]


def test_boundaries_are_ascii(spark):
    """Java's \\b takes letters of all scripts for word characters; with it the number beside one would stay."""
    df = spark.createDataFrame([("né078-05-1120",)], "t string")
    assert redact(df, ["t"], kinds=["ssn"]).first().t == "né[SSN]"
    assert df.where(F.col("t").rlike(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")).count() == 0


@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 20), st.integers(0, 19))
def test_chunks_hold_every_word_and_fit(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = cut(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


@given(st.text(min_size=1, max_size=40), st.integers(1, 16))
def test_hashed_vectors_are_of_unit_length(text, dimensions):
    assert abs(float((hashed_vector(text, dimensions) ** 2).sum()) - 1) < 1e-5


def test_words_that_cancel_out_have_a_vector():
    texts = ["Thtiorti thstin eresly edingnt.", "Thlyanes the aton ea.", "..."]
    assert [round(float((hashed_vector(x, 16) ** 2).sum()), 5) for x in texts] == [1, 1, 1]
