"""Fill-in-the-middle: the skip list against splitting, outputs against the rule, exact round trips."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from storkline.llm import fill_middle
from storkline.llm.fill_middle import SkipList, arrange, rearrange, restored


def by_rule(doc_id, text, share=100, spm_share=50):
    """The contract, over a list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm_share:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def run(docs, **how):
    out = rearrange(docs, **how).withColumn("restored", restored())
    return Counter(tuple(r) for r in out.collect())


def test_whole_table(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(docs) == Counter(by_rule(*r) for r in documents)
    forms = Counter(by_rule(*r)[2] for r in documents)
    assert min(forms["psm"], forms["spm"]) > 300


def test_shares(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    assert run(docs, share=30, spm_share=90) == Counter(by_rule(*r, 30, 90) for r in documents)


@pytest.mark.parametrize("lines", [0, 1, 63, 64, 65, 4095, 4096, 4097, 300_000])
@pytest.mark.parametrize("closed", [True, False])
def test_every_lane(lines, closed, monkeypatch):
    monkeypatch.setattr(fill_middle, "STRETCH", 1000)
    pick = random.Random(lines)
    parts = ["é" * pick.randrange(3) + "x" * pick.randrange(2) + "\n" for _ in range(lines)]
    text = "".join(parts) + ("" if closed else "😀end")
    lists = SkipList(text.encode())
    parts = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert lists.n == len(parts)
    for rank in {0, len(parts), *(pick.randrange(len(parts) + 1) for _ in range(50)), *range(min(len(parts), 200))}:
        before = "".join(parts[:rank])
        assert lists.find(rank) == (len(before), len(before.encode()))
    with pytest.raises(IndexError):
        lists.find(lists.n + 1)
    assert sum(len(lane[1]) for lane in lists.lanes) <= lines / 60 + 1


@settings(max_examples=300, deadline=None)
@given(st.integers(), st.text(alphabet="\n\r <>PSMé😀", max_size=60), st.integers(0, 100))
def test_any_text(doc_id, text, spm_share):
    n, form, prefix, middle, output = arrange(text.encode(), doc_id, 7, 100, spm_share)
    assert (doc_id, n, form, prefix, middle, output.decode()) == by_rule(doc_id, text, 100, spm_share)[:-1]


def test_text_of_sentinel_parts_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(["<\n<S\n<P", "P>\nS>\nM>\n", "<<\n>>\n<M", "a\n<P>b", "<\n", "\n\n\n", "<S\nS>\n<", "x"] * 20)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == Counter(by_rule(*r) for r in rows)


def test_odd_rows(spark, odd, nothing):
    assert run(odd) == Counter(by_rule(r.doc_id, r.text) for r in odd.collect())
    assert run(nothing) == Counter()


def test_a_long_text(spark):
    text = "".join(f"línea {i}\n" for i in range(400_000))
    docs = spark.range(1, 4).selectExpr("id as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    assert run(docs) == Counter(by_rule(i, text) for i in range(1, 4))
