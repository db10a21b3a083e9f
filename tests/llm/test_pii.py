import hashlib
import random
import re

from tabforge.llm import pii


def luhn(d):
    return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    out = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def samples():
    random.seed(8)
    bits = ["a", "b.c", "@", "x@y.z", ".", "1", "22", "255", "256.", "0007", "+1 (555) 555-5555", "+", "-", " ", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "\n", "_", "1.2.3.4", "(", ")", "٠"]
    return ["".join(random.choice(bits) for _ in range(random.randrange(40))) for _ in range(500)] + ["9 " * 30_000, "a" * 60_000 + "@b.c", "1.2.3.4 " * 3000]


def test_base_against_brute_force(spark):
    rows = [*enumerate(samples()), (0, None), (None, "")]
    got = {(r.doc_id, r.base_sha256): r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        found = brute(t or "")
        r = got[i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b for _, _, k in found) for b in pii.BASE]
        assert {f"{k}:{s}:{e}" for s, e, k in found} <= set(r.spans.split(",")) | {""}


def test_contexts_discover_identifiers(spark):
    random.seed(9)
    rows = [(i, f"w{random.random()} please call me at +1 ({random.randrange(100, 999)}) 555-{random.randrange(1000, 9999)} now") for i in range(60)]
    rows += [(100 + i, f"so call me at 07700-{random.randrange(100000, 999999)} now or later") for i in range(5)]
    rows += [(200 + i, f"chapter {i} page 12{i} of it") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "ctx_phone:14:26" for i in range(5))
    assert all("ctx" not in got[200 + i] for i in range(40))
    assert all("phone:" in got[i] for i in range(60))


def test_contexts_discover_identifiers_with_spaces(spark):
    random.seed(10)
    card = lambda ok: next(v for v in iter(lambda: " ".join(str(random.randrange(1000, 9999)) for _ in range(4)), None) if luhn(v.replace(" ", "")) == ok)
    rows = [(i, f"w{i}a please call me at +1 ({random.randrange(200, 999)}) 555-{random.randrange(1000, 9999)} now") for i in range(60)]
    rows += [(100 + i, f"w{i}a charge my card {card(True)} today") for i in range(60)]
    rows += [(200, "so call me at (555) 123-4567 now"), (201, f"so charge my card {card(False)}, today"), (202, "so call me at " + "x" * 70 + "7 now"), (203, "so call me at 1.2.3.4 5551234 now"), (204, "so call me at 10.2 5x7 now")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (200, 201, 202)] == ["ctx_phone:14:28", "ctx_card:18:37", "ctx_phone:14:85"]
    assert got[203] == "ip:14:21" and got[204] == "ctx_phone:14:18"


def test_empty_and_clashes(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz", "k")], "doc_id long, text string, base string")
    assert pii.find(df).head().spans[0].kind == "email"
    assert pii.digest(df.limit(0)).count() == 0


def test_evidence_travels_over_two_contexts_and_decoys_stay(spark):
    random.seed(11)
    number = lambda: f"0{random.randrange(1000, 9999)} {random.randrange(100000, 999999)}"
    shared = [number() for _ in range(30)]
    rows = [(i, f"w{i}a please call me at +1 ({random.randrange(200, 999)}) 555-{random.randrange(1000, 9999)} now") for i in range(60)]
    rows += [(100 + i, f"w{i}a so call me at {v} now") for i, v in enumerate(shared)]
    rows += [(200 + i, f"w{i}a her mobile rings {v} often") for i, v in enumerate(shared)]
    rows += [(300 + i, f"w{i}a his mobile rings {number()} often") for i in range(40)]
    rows += [(400 + i, f"w{i}a invoice order number {random.randrange(10**7, 10**8)} was paid") for i in range(300)]
    rows += [(800 + i, f"w{i}a invoice order number +1 (555) 555-{1000 + i} was paid") for i in range(8)]
    rows += [(900 + i, f"w{i}a on page number {i + 100} of it") for i in range(60)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = {i for i, r in got.items() if r.n_ctx}
    assert {*range(100, 130), *range(200, 230), *range(300, 340)} == hits
    assert all(r.spans.startswith("ctx_phone:") and r.n_ctx == 1 for i, r in got.items() if i in hits)
