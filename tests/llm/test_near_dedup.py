import re

import pytest

from lodestone.llm import near_dedup as nd
from lodestone.llm.common import Scratch


def brute(rows):
    """n_shingles and component of every id, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                group[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_components_equal_those_of_all_pairs(docs, prose):
    import random

    r, rows = random.Random(3), []
    for base in range(12):
        words = prose(60 + 20 * base, base).split()
        for copy in range(8):  # chains of near copies, many just around the threshold
            w = list(words)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"changed{r.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
            if copy % 3 == 0:
                words = w
    rows += [(200, rows[5][1].upper()), (201, None), (202, ""), (203, " \t\n"), (204, "one two"), (205, "ONE\ttwo"), (206, "one two three"), (207, prose(9000, 77)), (208, prose(9000, 77) + " end")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_crowded_group_of_near_copies(docs, prose):
    import random

    r, base = random.Random(9), prose(80, 1).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"c{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_rows_of_one_id_and_rows_without_id_are_linked_by_their_own_texts(docs, prose):
    text, other = prose(40, 2), prose(40, 3)
    rows = [(4, text), (2, text), (2, text), (None, text), (None, None), (9, other), (9, text + " end"), (None, prose(40, 4)), (None, prose(40, 4)), (3, other), (3, "")]
    got = [(r["doc_id"], r["component_id"], r["kept"], r["group_id"]) for r in nd.dedup(docs(rows)).collect()]
    want = [(4, 2, False), (2, 2, True), (2, 2, True), (None, 2, False), (None, None, True), (9, 3, False), (9, 2, False), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True)]
    assert sorted((r[:3] for r in got), key=str) == sorted(want, key=str)
    groups = [r[3] for r in got if r[3] is not None]
    assert len(groups) == 9 and sorted(groups.count(x) for x in set(groups)) == [2, 2, 5]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_the_stage_keeps_one_row_of_each_group(spark, tmp_path, docs, prose, limit, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(nd, "BROADCAST_IDS", limit)
    monkeypatch.setattr(nd.only_ids, "__defaults__", ("left_semi", limit))
    text, other = prose(40, 2), prose(40, 3)
    rows = [(5, text), (5, text), (5, other), (None, text), (None, other), (None, prose(50, 6)), (None, prose(50, 6)), (7, None), (None, "")]
    docs(rows).write.parquet(str(tmp_path / "t"))
    got = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(str(tmp_path / "t")), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([rows[i] for i in (0, 2, 5, 7, 8)], key=str)


def test_empty_table(docs):
    assert nd.dedup(docs([])).count() == 0


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    import numpy as np

    body = np.frombuffer((b"abc  def\tghi " * 50) + b"x" * 300 + b" end", np.uint8)
    whole = nd.Hasher().texts(body, np.array([0, len(body)]))[0]
    monkeypatch.setattr(nd, "PIECE", 16)
    assert (nd.Hasher().texts(body, np.array([0, len(body)]))[0] == whole).all() and len(whole) == 152


def test_a_pair_at_the_threshold_is_rarely_pruned():
    import random

    least, r, lost = nd.least_matches(), random.Random(4), 0
    for _ in range(3000):
        hits = [r.random() < 0.75 for _ in range(nd.HASHES)]
        lost += any(sum(hits[: (i + 1) * nd.BATCH]) < need for i, need in enumerate(least))
    assert lost <= 2


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 6), (20, 30)], []])
def test_components_of_a_chain(spark, links):
    got = {r["id"]: r["component"] for r in nd.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == ({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 1, 20: 20, 30: 20} if links else {})
