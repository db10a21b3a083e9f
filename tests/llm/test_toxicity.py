import random

from tabforge.llm import toxicity


def corpus(n=600):
    random.seed(4)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeo" for c in ("mur", "tin", "vos", "lak")]
    rows = []
    for i in range(n):
        w = [random.choice(vocab) for _ in range(random.randrange(20, 200))]
        y = int(i % 6 == 0)
        if y:
            for _ in range(max(2, len(w) // 25)):
                w.insert(random.randrange(len(w)), random.choice(["zorgon", "blarty", "quixle"]))
        rows.append((i, " ".join(w), y))
    return rows


def test_fold():
    assert toxicity.fold("М0R0N") == toxicity.fold("moron") and toxicity.fold("1diot") == toxicity.fold("idiot") == toxicity.fold("Idiоt")
    assert toxicity.fold("$tup1d") == toxicity.fold("stupid") and toxicity.fold("ｌｏｓｅｒ") == toxicity.fold("lo​ser")


def test_held_out_accuracy(spark):
    rows = corpus()
    train = [r for r in rows if r[0] % 4 != 2]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lex = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, lex).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)
    assert lex.score("you zorg0n, you qu1xle") > 0.5 > lex.score("zorgonite quixlement") and lex.score("") < 0.3


def test_exceptions_and_lengths():
    lex = toxicity.Lexicon({toxicity.fold("trash"): 5.0, "stem*": 2.0}, (toxicity.fold("trash can"),), 1.0, 0.0)
    assert lex.density("put it in the trash can") == 0 < lex.density("trash talk")
    assert lex.density("trash") > lex.density("trash" + " word" * 500)
    assert [round(w) for _, _, w in lex.hits("stemming trash, trashy stem xstem")] == [2, 5, 2]


def test_edges(spark):
    none = toxicity.learn(["a", "b"], [0, 0])
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "x" * 100_000, 9)], "doc_id long, text string, score int")
    out = toxicity.score(df, none)
    assert out.count() == 3 and out.filter("score >= 0.3").count() == 0 and out.columns == ["doc_id", "score", "n_hits", "density"]
    assert toxicity.score(df.limit(0), none).count() == 0
