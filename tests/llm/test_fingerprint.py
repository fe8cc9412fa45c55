import hashlib

from sedimark.llm import fingerprint


def brute(rows):
    """doc_id -> (n_chars, sha256 of the edited text), following the rule literally."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_text(documents, odd_texts):
    rows = odd_texts + [(100 + i, f"document number {i}. " * (i + 1)) for i in range(40)]
    got = fingerprint.compare_versions(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[1].fingerprint == by[2].fingerprint
    assert by[6].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_row_and_empty(documents):
    assert fingerprint.compare_versions(documents([(1, "a b c d e f")])).first().near_next == 1.0
    assert fingerprint.compare_versions(documents([])).count() == 0


def test_peeling_recovers_the_difference(spark):
    """Differences of every size, those that need larger sketches included."""
    rows = [
        (n, [i * 0x9E3779B97F4A7C15 % 2**63 for i in range(n)], [i * 0x9E3779B97F4A7C15 % 2**63 for i in range(n // 2, n + n // 3)])
        for n in (0, 1, 5, 20, 60, 100, 400, 3000)
    ]
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    df = df.withColumn("sa", fingerprint.sketch("a")).withColumn("sb", fingerprint.sketch("b"))
    got = df.selectExpr("n", f"{fingerprint.difference_sql('a', 'sa', 'b', 'sb')} as d")
    assert {r.n: r.d for r in got.collect()} == {n: len(set(a) ^ set(b)) for n, a, b in rows}
    peeled = df.filter("n = 20").selectExpr(
        f"{fingerprint.peel_sql(fingerprint.subtract_sql('sa', 'sb'))} as p"
    ).first().p
    a, b = set(rows[3][1]), set(rows[3][2])
    assert peeled.ok and {(f.k, f.n) for f in peeled.found} == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}


def test_short_edited_texts_stay_near(documents):
    """One line of 50 to 600 characters, the last third replaced, is nearer than another text."""
    rows = []
    for i in range(50, 601, 10):
        text, n = "", 0
        while len(text) < i:
            text += hashlib.sha256(f"{i} {n}".encode()).hexdigest()[: 2 + (i + n) % 9] + " "
            n += 1
        rows.append((i, text[:i]))
    got = fingerprint.compare_versions(documents(rows)).collect()
    assert len(got) == len(rows) and all(r.near_edited > r.near_next for r in got)


def test_a_difference_is_one_fold(spark):
    """Subtracting goes cell by cell, and a part of the larger sketch is summed up at once: no sorting
    of structs, two folds over entries (digests of both texts at once, then those peeled out)."""
    assert "array_sort" not in fingerprint.subtract_sql("sa", "sb")
    larger = fingerprint._larger_sql("a", "b", 48, 0)
    assert larger.count("array_sort(") == 2
    rows = [(n, [(i + 1) * 0x9E3779B97F4A7C15 % 2**63 for i in range(n)]) for n in (0, 1, 90)]
    df = spark.createDataFrame(rows, "n long, a array<long>").withColumn("s", fingerprint.sketch("a"))
    for r in df.collect():
        cells = [[0, 0] for _ in range(96)]
        for d in r.a:
            for row in range(3):
                at = cells[(d >> (5 * row)) % 32 + 32 * row]
                at[0], at[1] = at[0] + 1, at[1] ^ d
        assert [[c.n, c.k] for c in r.s] == cells
        assert all(c.i == (i if c.n else -1) for i, c in enumerate(r.s))
