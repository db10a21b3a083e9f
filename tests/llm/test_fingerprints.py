import hashlib
import random
import statistics
import struct

import xxhash

from tabforge.llm import fingerprints


def xx(*values):
    """Spark's xxhash64 of longs, (int,) tuples for ints, text and nulls, unsigned."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<Q", v % 2**64)
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def numbered(text):
    """(hash, place) of the numbered k-mers in the order of their hashes."""
    low, w = fingerprints._LOW, [xx(t) for t in text.split()]
    seen, out = {}, []
    grams = []
    for i in range(max(len(w) - 2, min(len(w), 1))):
        grams.append((xx(*(w[i + k] if i + k < len(w) else None for k in range(3))) >> (low + 1), i))
    for g, i in sorted(grams):
        seen[g] = seen.get(g, -1) + 1
        out.append((xx(g, (seen[g],)) >> (low + 1), i))
    return sorted(out)


def brute_slots(text):
    """Every slot by sorting all numbered k-mers in the slot's own order."""
    e, n = numbered(text), fingerprints.SLOTS
    width = 63 - fingerprints._LOW - 6
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    out = []
    for j in range(n if e else 0):
        rank = {b: (b != j, signed(xx((j,), (b,))) & -n | b) for b in {h >> width for h, _ in e}}
        least = sorted(e, key=lambda x: (rank[x[0] >> width], x))[:2]
        out.append(xx(*(h for h, _ in sorted(least, key=lambda x: x[1]))) & 65535)
    return out


def test_every_slot_against_brute_force(spark):
    random.seed(13)
    rows = [(i, " ".join(f"w{random.randrange(40)}" for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 20, 40, 64, 100, 150, 300, 1000, 4000] * 2)] + [(99, "same " * 500)]
    got = {r.doc_id: r.p for r in fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "p").collect()}
    for i, t in rows:
        assert got[i] == brute_slots(t), i


def test_likeness_varies_as_with_independent_orders():
    random.seed(14)
    for kmers in (12, 40):
        own, free = [], []
        for trial in range(250):
            a = [f"{trial} {random.random()}".replace(" ", "_") for _ in range(kmers + 2)]
            b = list(a)
            for k in random.sample(range(len(b)), max(1, kmers // 12)):
                b[k] = "edit"
            x, y = brute_slots(" ".join(a)), brute_slots(" ".join(b))
            own.append(sum(p == q for p, q in zip(x, y, strict=True)) / 64)
            pick = lambda e, j: [h for h, _ in sorted(sorted(e, key=lambda z: xx(z[0], (j,)))[:2], key=lambda z: z[1])]
            ea, eb = numbered(" ".join(a)), numbered(" ".join(b))
            free.append(sum(pick(ea, j) == pick(eb, j) for j in range(64)) / 64)
        assert statistics.stdev(own) <= 1.1 * statistics.stdev(free)
        assert abs(statistics.mean(own) - statistics.mean(free)) < 0.02


def edited(rows):
    """Brute force: next document by id, nulls first, of repeated ids any one text may follow."""
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    out = []
    for i, t in rows:
        t, nxt = t or "", texts[ids[(ids.index(i) + 1) % len(ids)]]
        half = len(t) // 2
        out.append((i, len(t), {hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest() for n in nxt}))
    return out


def test_contract_against_brute_force(spark):
    random.seed(11)
    words = ["ab", "cd", "é", "😀x", "zz", "日本語"]
    rows = [(i * 3, " ".join(random.choice(words) for _ in range(random.randrange(60)))) for i in range(80)] + [(None, "null id"), (7, None), (8, ""), (9, "one"), (9, "one"), (10**12, "last of all " * 40)]
    out = fingerprints.compared(spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars int, __tf_e string").repartition(5)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.n_chars), []).append(r.edited_sha256)
    for i, n, hashes in edited(rows):
        assert set(got[i, n]) <= hashes or len([1 for a, m, _ in edited(rows) if (a, m) == (i, n)]) > 1
    by_text = {}
    for r, (i, t) in ((r, x) for x in rows for r in out if (r.doc_id, r.n_chars) == (x[0], len(x[1] or ""))):
        by_text.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_likeness_falls_with_edits_and_order(spark):
    random.seed(12)
    base = [f"w{random.randrange(400)}" for _ in range(600)]
    few, many = list(base), list(base)
    for k in random.sample(range(600), 6):
        few[k] = "x"
    for k in random.sample(range(600), 120):
        many[k] = "y"
    moved = base[300:] + base[:300]
    rows = list(enumerate(map(" ".join, (base, few, many, moved, [f"q{i}" for i in range(600)], base))))
    df = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "p")
    p = [r.p for r in df.orderBy("doc_id").collect()]
    like = [sum(a == b for a, b in zip(p[0], q, strict=True)) / fingerprints.SLOTS for q in p]
    assert like[5] == 1 and like[4] < 0.05 and like[1] > 0.8 > like[2] > like[4]
    assert like[3] < 0.85  # the same k-mers in another order: MinHash would say about 1


def test_occurrences_count_and_edges(spark):
    rows = [(0, "a b c " * 50), (1, "a b c " * 500), (2, ""), (3, None), (4, " \n"), (5, "one two"), (6, "x " * 60_000)]
    p = {r.doc_id: r.p for r in fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "p").collect()}
    assert p[0] != p[1] and p[2] == p[3] == p[4] == [] and len(p[5]) == fingerprints.SLOTS and len(set(p[6])) > 40
    assert fingerprints.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.compared(spark.createDataFrame([(1, "just one here")], "doc_id long, text string")).head()
    assert one.near_next == 1.0 and len(one.fingerprint) == 4 * fingerprints.SLOTS
