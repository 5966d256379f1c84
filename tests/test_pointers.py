"""Long lists followed by way of posts."""

import random

from strandweave.operators import pointers
from strandweave.session import cut_lineage


def test_rounds_write_what_they_move(spark, monkeypatch):
    """A list of 3,000 rows, a tree on it and two rings; all rounds together write a few times the rows, not a multiple by rounds."""
    rng, n = random.Random(8), 3000
    ids = rng.sample(range(10 * n), n + 440)
    run, twigs, ring, loop = ids[:n], ids[n:n + 400], ids[n + 400:-1], ids[-1]
    rows = [(x, run[k - 1] if k else x, int(k > 0), k % 7, k == 0) for k, x in enumerate(run)]
    at = {x: k for k, x in enumerate(run)}
    leads = {x: rng.choice(run) for x in twigs}
    rows += [(x, y, 1, 5, False) for x, y in leads.items()]
    rows += [(x, ring[k - 1], 1, 1, False) for k, x in enumerate(ring)] + [(loop, loop, 1, 1, False)]
    rng.shuffle(rows)
    written = []

    def counted(df):
        table = cut_lineage(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(pointers, "cut_lineage", counted)
    links = spark.createDataFrame(rows, "id long, ptr long, dist long, weight long, done boolean")
    got = {r["id"]: tuple(r)[1:] for r in pointers.follow(links, 100).collect()}
    before = [0]
    for k in range(1, n):
        before.append(before[-1] + k % 7)
    assert len(got) == len(rows)
    assert all(got[x] == (run[0], k, before[k], True) for k, x in enumerate(run))
    assert all(got[x] == (run[0], at[y] + 1, before[at[y]] + 5, True) for x, y in leads.items())
    assert not any(got[x][3] for x in [*ring, loop])
    assert sum(written) < 8 * len(rows)
