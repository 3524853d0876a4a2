"""Every core query against its SQL on the smallest tables."""

import os
import re

import pytest

from lectern import queries as Q
from lectern.operators import notes as N
from tests.oracle import connect, same

FOLDER = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    frame = Q.queries()[name](spark, FOLDER)
    if name in Q.oracle_sql():
        same(frame, con, Q.oracle_sql()[name])
    else:
        columns, rows = BY_HAND[name](con)
        assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows


def _markers(con):
    """(book, chapter, marker) of every printed marker of the newest deliveries, one chapter after the other."""
    newest = con.execute("SELECT book_id, chapter_id, content FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY fetched_at DESC) AS k FROM chapters WHERE chapter_id IS NOT NULL) WHERE k = 1").fetchall()
    return [(b, c, m) for b, c, content in newest for m in N.printed_markers([x or "" for x in content or ()])]


def _unlinked(con):
    linked = {(c, r["paragraph_index"], r["start_offset"], r["end_offset"]) for c, refs in con.execute("SELECT chapter_id, refs FROM footnotes").fetchall() for r in refs or ()}
    rows = [(c, m["paragraph_index"], m["start"], m["marker"]) for _, c, m in _markers(con) if (c, m["paragraph_index"], m["start"], m["end"]) not in linked]
    return ("chapter_id", "paragraph_index", "start", "marker"), rows


def _key(marker):
    bare = marker.strip("[]［］〔〕【】 \t")
    if re.fullmatch("[①-⑳]", bare):
        return bare
    number = re.match("[0-9]*", bare)[0]
    return marker[0].replace("［", "[") + (re.sub("^0+(?=[0-9])", "", number) if number else "") + bare[len(number) :]


def _resolved(con):
    """The tiers of definitions, one reference after the other: those of the chapter, else of the book, unless its chapters number that family anew."""
    notes = con.execute("SELECT DISTINCT footnote_id, book_id, chapter_id, marker, content FROM footnotes WHERE marker IS NOT NULL").fetchall()
    chapter, book, anew = {}, {}, {}
    for _, b, c, marker, content in notes:
        k, text = _key(marker), "\0".join(content or [])
        chapter.setdefault((b, c, k), set()).add(text)
        book.setdefault((b, k), set()).add(text)
        anew.setdefault((b, k), set()).add(c)
    again = {(b, k[0]) for (b, k), cs in anew.items() if len(cs) > 1 and len(book[b, k]) > 1}
    rows = []
    for b, c, m in _markers(con):
        k = _key(m["marker"])
        tier, found = (2, chapter[b, c, k]) if (b, c, k) in chapter else (3, book.get((b, k), set()) if (b, k[0]) not in again else set())
        outcome = "resolved" if len(found) == 1 else "ambiguous" if found else "missing-definition"
        rows.append((c, m["paragraph_index"], m["start"], m["marker"], tier if outcome == "resolved" else None, outcome))
    return ("chapter_id", "paragraph_index", "start", "marker", "tier", "outcome"), rows


#: Queries without SQL: what they must return, worked out in plain Python.
BY_HAND = {"x6_unlinked_markers": _unlinked, "j12_resolved_markers": _resolved}
