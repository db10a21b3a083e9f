import math
import random
import re
from collections import Counter

from tabforge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines, had, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in had
            had.add(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def texts():
    random.seed(5)
    out = ["", None, " \n\t ", "a", "a b", "a b c", "a b c a b c", "x " * 300, "a\n\na\n a\na", "é😀 #|<b>\x0b\x0c\x0dq", " u v"]
    out += [" ".join(random.choice("abcd") for _ in range(random.randrange(120))) for _ in range(60)]
    return out + ["\n".join(random.choice(["l one", "l two", "", " ", "l one "]) for _ in range(30)) for _ in range(20)]


def test_measures_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(0, "a b", "en"), (None, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judged(df, spark.createDataFrame([], "doc_id long, quality int"), keep=["text"])
    got = Counter((r.doc_id, r.text, r.measures.n_words, r.measures.word_chars, r.measures.n_symbols, r.measures.n_dup_lines, r.measures.n_repeat_words, r.base_failed, r.kept) for r in out.collect())
    assert got == Counter((i, t, *(b := brute(t)), not b[-1]) for i, t, _ in rows)


def test_binomial_is_exact():
    for k, n, p in [(0, 10, 0.1), (3, 20, 0.2), (5, 1000, 0.01), (19, 20, 0.9), (20, 20, 0.5), (0, 2000, 0.005)]:
        assert abs(quality.binomial_at_most(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_certified_stops_where_the_bound_fails():
    steps = {0: (5000, 10), 5: (100, 20), 20: (1, 300), 35: (0, 200)}
    cut = quality.certified({("en", "symbols"): steps, ("de", "symbols"): {0: (20, 0), 30: (0, 20)}}, alpha=0.01, delta=0.05)
    assert cut["en"]["symbols"] == 19 or 5 <= cut["en"]["symbols"] < 20
    assert cut["de"] == {}


def test_clashing_names_and_verdict(spark):
    random.seed(1)
    good = " ".join(f"w{i}" for i in range(80))
    bad = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, bad if i % 4 == 0 else good, "en", 7) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(8000)], "doc_id long, quality int")
    out = quality.judged(df, labels)
    assert {"words", "text"} <= set(out.columns)
    assert out.filter("kept").count() == 6000 and out.filter("kept AND doc_id % 4 = 0").count() == 0
