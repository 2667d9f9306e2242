import random

import numpy as np

from geopanel.llm import paragraphs as p


def made_up(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left(documents):
    passage = made_up(60, 1)
    texts = [(i, f"{made_up(40 + i, 10 + i)} {passage} {made_up(30, 100 + i)}") for i in range(1, 6)]
    clean = [(50 + i, made_up(150, 500 + i)) for i in range(10)]
    short = [(80 + i, f"{made_up(60, 700 + i)} one two three four five six seven {made_up(60, 800 + i)}") for i in range(5)]
    docs = documents(texts + clean + short)
    rows = p.repeated(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in rows if r.removed} == {2, 3, 4, 5} and all(r.first_ids == [1] for r in rows)
    by_id = dict(texts)
    for r in rows:
        assert by_id[r.doc_id].encode()[r.begin : r.end].decode() in passage
    left = {r.doc_id: r.text for r in p.without_repeats(docs, p.repeated(docs)).collect()}
    assert left[1] == by_id[1] and all(left[i] == t for i, t in clean + short)
    assert all(len(left[i]) < len(by_id[i]) - 100 for i in (2, 3, 4, 5))


def test_shared_band_values_come_from_a_sort_by_one_number(spark):
    rows = [(0, 7, 1), (0, 7, 2), (1, 7, 3), (0, 8, 4), (1, 9, 5), (1, 9, 6), (2, 10, 7), (-3, 11, 8)]
    found = p._mixed_groups(spark.createDataFrame(rows, "band int, value long, h long"))
    assert {2, 1, 5, 6, 8} <= {r.h for r in found.collect()} <= {1, 2, 3, 5, 6, 8}
    sort = found._jdf.queryExecution().optimizedPlan().toString().split("Sort [")[1].split("]")[0]
    assert sort.startswith("value") and "," not in sort


def test_two_sets_are_compared_as_in_larger_groups():
    random.seed(4)
    for _ in range(300):
        x, y = (frozenset(random.sample(range(9), random.randint(1, 9))) for _ in "xy")
        assert len(p.similar_pairs([x, y], 0.8)) == len(p.similar_pairs([x, y, frozenset([99])], 0.8))


def test_a_text_against_itself_is_taken_whole():
    h = p.word_hashes(made_up(60, 2).encode().split())
    for i in (0, 9, 40, 56, 58):
        assert p.stretch(h, h, i, i, 10, p.Settings()) == p.stretch(h, h.copy(), i, i, 10, p.Settings())
    assert p.stretch(h, h, 9, 9, 10, p.Settings()) == (0, 60, 0, 60)


def test_near_paragraphs_are_linked():
    words = made_up(40, 3).split()
    a, b = frozenset(zip(words, words[1:])), frozenset(zip(words[2:], words[3:]))
    c = frozenset([("x", str(i)) for i in range(39)])
    assert p.similar_pairs([a, b, c, a | c], 0.8) == [(0, 1)] or p.similar_pairs([a, b, c, a | c], 0.8) == [(1, 0)]


def test_similar_pairs_equal_all_pairs():
    random.seed(6)
    sets = [frozenset(random.sample(range(24), random.randint(1, 12))) for _ in range(150)]
    sets += [s - {min(s)} for s in sets if len(s) > 6]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    own = list(range(len(sets)))
    for i, j in p.similar_pairs(sets, 0.8):
        a, b = own[i], own[j]
        own = [min(a, b) if v in (a, b) else v for v in own]
    assert own == label


def test_dealing_again_keeps_links(documents):
    base = made_up(400, 9).split()
    texts = []
    for i in range(12):
        w = list(base)
        w[33 * i + 1] = f"new{i}"
        texts.append((i, " ".join(w)))
    key = lambda rows: {(r.doc_id, r.paragraph, r.removed) for r in rows}
    assert key(p.repeated(documents(texts)).collect()) == key(p.repeated(documents(texts), most=2).collect())


def test_paragraphs_follow_content():
    h = p.word_hashes(made_up(300, 2).encode().split())
    shifted = np.r_[p.word_hashes([b"q1", b"q2", b"q3"]), h]
    a, b = (set(p.cuts(x, np.zeros(x.size, int), 5) - k) for x, k in ((h, 0), (shifted, 3)))
    assert len(a & b) > 0.85 * len(a)


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    rows = p.repeated(docs)
    assert rows.where("doc_id is null").count() == 0
    assert p.without_repeats(docs, rows).where("doc_id = 1").count() == 2
    assert p.repeated(documents([])).collect() == []


def test_batches_do_not_change_paragraphs():
    texts = [made_up(n, n).encode() for n in (0, 1, 2, 3, 7, 90, 400)] + [b" a\n\tb  c ", b""]
    together = p.paragraph_rows(texts, p.Settings(), sets=True, spans=True, bands=True)
    for i, t in enumerate(texts):
        mine = together["at"] == i
        alone = p.paragraph_rows([t], p.Settings(), sets=True, spans=True, bands=True)
        for k in ("no", "words", "h", "begin", "end"):
            assert together[k][mine].tolist() == alone[k].tolist()
        assert [v[mine].tolist() for v in together["bands"]] == [v.tolist() for v in alone["bands"]]
        words = t.split()
        assert sum(alone["words"]) == len(words)
        if words:
            assert t[alone["begin"][0] : alone["end"][0]].split() == words[: alone["words"][0]]


def test_changed_passages_are_cut_whole(documents):
    """Passages of 51 to 100 words with as many changed words as a similarity of 0.8 allows, at many places."""
    rows, places = [], {}
    for k, (size, changes) in enumerate([(51, (25,)), (60, (12,)), (60, (30,)), (60, (47,)), (75, (40,)), (100, (31, 67)), (100, (20, 80))] * 4):
        passage = made_up(size, 2000 + k).split()
        near = [f"new{k}" if i in changes else w for i, w in enumerate(passage)]
        before = made_up(30 + k, 3000 + k).split()
        rows.append((2 * k, f"{made_up(30 + 2 * k, 4000 + k)} {' '.join(passage)} {made_up(40, 5000 + k)}"))
        rows.append((2 * k + 1, " ".join([*before, *near, made_up(40, 6000 + k)])))
        places[2 * k + 1] = (" ".join(before) + " ", " ".join(near))
    got = {r.doc_id: (r.begin, r.end, r.first_ids) for r in p.repeated(documents(rows)).where("removed").collect()}
    whole = [i for i, (a, b) in places.items() if i in got and 0 <= len(a) - got[i][0] < 10 and 0 <= got[i][1] - len(a + b) < 10 and got[i][2] == [i - 1]]
    assert len(whole) >= 0.95 * len(places) and set(got) <= set(places)


def test_a_repeated_period_keeps_its_first_one(documents):
    period = made_up(40, 77)
    docs = documents([(1, " ".join([period] * 3))])
    assert [r.text.strip() for r in p.without_repeats(docs, p.repeated(docs)).collect()] == [period]


def test_lists_of_a_sliced_column_are_arrays():
    import pyarrow as pa

    whole = pa.array([{"x": [1, 2]}, {"x": []}, {"x": [3]}, {"x": [4, 5, 6]}], pa.struct({"x": pa.list_(pa.int32())}))
    for part, want in ((whole, [[1, 2], [], [3], [4, 5, 6]]), (whole.slice(1, 2), [[], [3]]), (whole.slice(3), [[4, 5, 6]])):
        assert [x.tolist() for x in p._lists(part.field("x"))] == want
