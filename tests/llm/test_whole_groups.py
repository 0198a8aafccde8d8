"""Rows without ids and repeated rows in the n-gram Jaccard join."""

from tallyframe.llm import jaccard_join as jj
from tests.llm.cases import frame, prose


def chain():
    """Three texts of which only the middle one, without an id, is near both others."""
    base = prose(31, 200, 2000).split()
    middle, last = base[:], base[:]
    middle[20:22] = ["m1", "m2"]
    last[20:22], last[120:122] = ["m1", "m2"], ["l1", "l2"]
    return [" ".join(x) for x in (base, middle, last)]


def test_links_through_texts_without_ids(spark):
    a, b, c = chain()
    rows = [(1, a, "en", "a", 1), (None, b, "en", "a", 1), (2, c, "en", "a", 1), (3, prose(77, 90, 2000), "en", "a", 1)]
    ids = lambda rows: sorted(map(str, ((r.doc_id, r.component_id) for r in jj.linked(frame(spark, rows), 3, 95).collect())))
    assert ids(rows) == sorted(map(str, [(1, 1), (None, 1), (2, 1), (3, 3)]))
    # the middle text is needed
    assert ids([rows[0], *rows[2:]]) == sorted(map(str, [(1, 1), (2, 2), (3, 3)]))


def test_one_row_of_each_group(spark):
    a, b, _ = chain()
    alone, other = prose(77, 90, 2000), prose(78, 90, 2000)
    rows = [(None, a, "en", "a", 1), (None, b, "en", "a", 1), (None, a, "en", "a", 1), (4, alone, "en", "a", 1), (4, alone, "en", "a", 1),
            (4, alone + " end", "en", "a", 1), (4, other, "en", "a", 1), (5, "", "en", "a", 1), (6, None, "en", "a", 1)]
    found = [(r.doc_id, r.text) for r in jj.one_of_each_group(frame(spark, rows, clashes=True)).collect()]
    assert len(found) == 5
    assert [x for i, x in found if i is None][0] in (a, b) and (4, other) in found and (5, "") in found and (6, None) in found
    assert len([x for i, x in found if i == 4]) == 2
