"""Fill-in-the-middle against string slices, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from resight.llm import middles
from resight.llm.queries import QUERIES

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = [(1, None), (2, ""), (3, " "), (4, "one"), (5, " one  two\n"), (5, " one  two\n"), (5, "other"), (None, "no id here"),
        (7, "has <S> in it"), (8, "<"), (9, "a <P"), (10, "é日本 \x0b語  x"), (11, "zz " * 50000), (12, "<<S <M"), (-3, "minus three words")]
ROWS += [(100 + i, f"é{i} b c\td e  f{i}<\n") for i in range(60)]


def brute(key, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id long, text string, output string, id int").repartition(3)
    got = middles.fill_in_middle(df)
    want = [(k, *brute(k, t)) for k, t in ROWS]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in want}
    back = middles.restore_texts(got)
    assert sorted((r["doc_id"], r["restored"]) for r in back.collect() if r["doc_id"]) == sorted((k, t or "") for k, t in ROWS if k)
    assert middles.fill_in_middle(df.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {(r["doc_id"], *(b := brute(r["doc_id"], r["text"]))[:4], sha(b[4]), sha(r["text"] or "")) for r in docs}
    assert {tuple(r) for r in QUERIES["op11_block_rotation"](spark, SMALL).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM> \n\x0bé日"), st.integers(-5, 500))
def test_round_trip(text, key):
    params = middles.MiddleParams(rate=100)
    _, form, _, _, output = middles.rearranged(text.encode(), key, params)
    assert middles.restored(output, form, params).decode() == text


@pytest.mark.parametrize("cut", range(6))
def test_rotation(cut):
    held = bytearray(b"ABCDEF")
    middles.rotate(held, 0, cut, 6)
    assert bytes(held) == b"ABCDEF"[cut:] + b"ABCDEF"[:cut]
