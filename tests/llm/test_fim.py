"""Operator 13 against a plain version, and its odd cases."""

import hashlib
import re

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import fim_fenwick as fim
from riskloom.llm.queries import QUERIES


def units(text, unit):
    if unit == "chars":
        return list(text)
    own = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
    rest = text[len("".join(own)) :]
    return own + [rest] * bool(rest)


@pytest.mark.parametrize("unit", ["chars", "words"])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\té漢😀", max_size=60), st.integers(1, 9))
def test_every_cut_is_found(unit, text, block):
    parts, tree = units(text, unit), fim.Blocks(text.encode(), unit, block)
    assert (tree.n_units, tree.n_points) == (len(parts), len(text))
    for n in range(len(parts) + 1):
        head = "".join(parts[:n])
        assert tree.cut(n) == (len(head.encode()), len(head))


def plainly(doc_id, text, seed=1, plain=10, spm=20, unit="chars"):
    text = text or ""
    parts = units(text, unit)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["a<P>b", "<M>", "< P>", "<P", "x<S><", "P>" * 50, "<" * 300, "😀" * 5000, "é\n" * 3000, "x" * 3_000_000, "w " * 400_000]
DATA = [*brute.rows(), *[(900 + i, t, "", "", 0, *"abcdefg") for i, t in enumerate(ODD * 3)], (None, "no id here", "", "", 0, *"abcdefg"), (901, "other text", "", "", 0, *"abcdefg")]
DATA += DATA[3:5]


@pytest.mark.parametrize("options", [{}, {"seed": 7, "plain": 0, "spm": 50, "unit": "words"}, {"plain": 100}, {"plain": 0, "spm": 100}])
def test_rearranged(spark, options):
    docs = brute.documents(spark, DATA)
    made = fim.rearranged(docs, **options)
    assert made.columns == [*docs.columns, "n_units", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(str((tuple(r)[:-6], tuple(r)[-6:-1], r.back)) for r in back.collect())
    assert got == sorted(str((r, plainly(r[0], r[1], **options), r[1] or "")) for r in DATA)


def test_all_forms_occur():
    assert {plainly(r[0], r[1])[1] for r in DATA} == {"plain", "psm", "spm"}


def test_columns_of_the_same_name_are_replaced(spark):
    docs = spark.createDataFrame([("x", "some text", 5, "old")], "form string, text string, doc_id long, output string")
    made = fim.rearranged(docs)
    assert made.columns == ["text", "doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    assert tuple(made.first())[2:] == plainly(5, "some text") and fim.rearranged(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.rearranged(docs, unit="lines")


def test_query_columns(spark, tmp_path):
    brute.documents(spark, DATA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {str(tuple(r)) for r in QUERIES["op13_fim_fenwick"](spark, str(tmp_path)).collect()}
    want = [(r[0], *plainly(r[0], r[1]), r[1] or "") for r in DATA]
    assert got == {str((*w[:-2], brute.sha(w[-2].encode()), brute.sha(w[-1].encode()))) for w in want}
