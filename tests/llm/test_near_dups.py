"""Near duplicates against all pairs."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from storkline.llm import near_dups, queries
from storkline.llm.near_dups import drop_near_duplicates, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def by_all_pairs(rows, width, percent):
    """doc_id: (size of its set, smallest doc_id reachable)."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, own in sets.items():
        common = Counter(j for s in own for j in holders[s] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(own), root(i)) for i, own in sets.items()}


def found(spark, rows, width, percent):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_whole_table(spark, documents, width, percent):
    assert found(spark, documents, width, percent) == by_all_pairs(documents, width, percent)


def test_large_groups_of_edited_copies(spark):
    """Copies of one text with one to twelve words changed: some pairs are links, many are not; and
    short texts that share one passage."""
    pick = random.Random(5)
    new = lambda: "".join(pick.choices("abcdefgh", k=7))
    base, passage, rows = [new() for _ in range(150)], " ".join(new() for _ in range(30)), []
    for i in range(400):
        own = list(base)
        for _ in range(pick.choice([1, 2, 3, 4, 6, 9, 12])):
            own[pick.randrange(len(own))] = new()
        rows.append((1000 + i, " ".join(own)))
    rows += [(3000 + i, passage + " " + " ".join(new() for _ in range(pick.randrange(2, 30)))) for i in range(300)]
    rows += [(5000 + i, rows[0][1]) for i in range(50)]
    assert found(spark, rows, 3, 85) == by_all_pairs(rows, 3, 85)


def test_overlap_bound_is_a_tail():
    assert near_dups.overlap_bound(32, 100) == 32
    assert 10 <= near_dups.overlap_bound(32, 80) < near_dups.overlap_bound(32, 85) < 20


def test_odd_rows(spark, odd, nothing):
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(odd, 3, 85).collect()}
    assert out[1, 0] == (1, True) and out[2, 0] == (2, True) and out[3, 0] == (3, True) and out[4, 1] == (4, True)
    assert out[5, 4] == (5, True) and out[6, 4] == (5, False) and out[None, 4] == (None, True) and out[None, 0] == (None, True)
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 9]
    assert near_duplicates(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_minhash_near_dedup(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE_SQL['op8_minhash_near_dedup']})").fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(sql)
