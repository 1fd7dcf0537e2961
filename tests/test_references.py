"""Dangling references against brute force, on rows with every kind of gap."""

import random
from datetime import datetime, timedelta

from notelake.operators import references as R

NOTES = "id string, agent_id string, title string, path string, created_at timestamp_ntz, title_extra string"
LINKS = "link_id long, from_document_id string, agent_id string, to_title string, to_path string, indexed_at timestamp_ntz, key string, at string"
GONE = "document_id string, path string, removed_at timestamp_ntz, restored_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def brute(links, notes, removed):
    def there(n, t):
        if t is None:
            return n[4] is None
        if n[4] is not None and n[4] > t:
            return False
        return not any(r[0] == n[0] and r[2] is not None and r[2] <= t and (r[3] is None or r[3] > t) for r in removed)

    tk = lambda s: s.split("#")[0].split("|")[0].strip().lower()
    def pk(s):
        s = s.strip().replace("\\", "/")
        while s.startswith("./"):
            s = s[2:]
        return s
    found = set()
    live = [n for n in notes if n[0] is not None]
    for l in links:  # noqa: E741
        if l[1] and l[1].strip() and not any(n[0] == l[1] and there(n, l[5]) for n in live):
            found.add((l[0], "from_document_id"))
        if l[3] and l[3].strip() and not any(n[2] is not None and tk(n[2]) == tk(l[3]) and (n[1] or "shared") in (l[2] or "shared", "shared") and there(n, l[5]) for n in live):
            found.add((l[0], "to_title"))
        if l[4] and l[4].strip() and not any(n[3] is not None and pk(n[3]) == pk(l[4]) and there(n, l[5]) for n in live):
            found.add((l[0], "to_path"))
    return found


def test_random_vault_equals_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: T0 + timedelta(days=rnd.randint(0, 40))
    ids = [f"n{i}" for i in range(12)] + [None]
    notes = [(rnd.choice(ids), rnd.choice(["a", "shared", None]), rnd.choice(["One", "two ", "Three", None]), rnd.choice(["x/a.md", "x/b.md", None]), rnd.choice([None, day(), day()]), "e") for _ in range(40)]
    removed = [(rnd.choice(ids), "p", rnd.choice([None, day(), day(), day()]), rnd.choice([None, day()])) for _ in range(30)]
    links = [
        (i, rnd.choice([*ids, "gone", "", " "]), rnd.choice(["a", "b", "shared", None]), rnd.choice(["one", "ONE#s", " Two|x", "#only", None, " ", "three"]),
         rnd.choice(["./x/a.md", "x\\b.md", "y.md", None, ""]), rnd.choice([None, day(), day(), day()]), "k", "t")
        for i in range(200)
    ]
    links += links[:20]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = R.orphan_references(df(links, LINKS), df(notes, NOTES), df(removed, GONE)).collect()
    assert {(r.link_id, r.ref_field) for r in got} == brute(links, notes, removed)


def test_hot_notes_and_keys(spark):
    hour = lambda i: T0 + timedelta(hours=i)
    # one note with very many removals, many of them overlapping, and many notes of one title that were all removed once
    removed = [("hot", "p", hour(6 * i), hour(6 * i + (9 if i % 5 == 0 else 2))) for i in range(300)] + [(f"t{i}", "p", hour(6 * i + 1), None) for i in range(300)]
    notes = [("hot", "a", "Hot", "hot.md", T0, "e")] + [(f"t{i}", "shared", "Same", f"t{i}.md", hour(6 * i), "e") for i in range(300)]
    links = [(i, "hot", "b", "SAME#x", "./hot.md", hour(i), "k", "t") for i in range(0, 1850, 7)]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = R.orphan_references(df(links, LINKS), df(notes, NOTES), df(removed, GONE)).collect()
    want = brute(links, notes, removed)
    assert {(r.link_id, r.ref_field) for r in got} == want and {f for _, f in want} == set(R.FIELDS)


def test_empty_sides(spark):
    links = spark.createDataFrame([(1, "n", "a", "T", "p", T0, "k", "t")], LINKS)
    none = lambda ddl: spark.createDataFrame([], ddl)
    assert R.orphan_references(links, none(NOTES), none(GONE)).count() == 3
    assert R.orphan_references(none(LINKS), none(NOTES), none(GONE)).count() == 0
    counts = R.orphan_counts(links, none(NOTES), none(GONE)).collect()
    assert {(r.ref_field, r.month, r.refs, r.orphans) for r in counts} == {(f, "2025-01", 1, 1) for f in R.FIELDS}
