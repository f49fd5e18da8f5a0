import random

import numpy as np

from pyspark.sql import functions as F

from loomgraph.llm import abuse as a

WORDS = "you are a worthless idiot and nobody wants here keep the out they breed like rats she pulled off his clothes coward everyone laughs behind your back smash face go to hell filthy".split()


def disguise(rng, w):
    kind = rng.randrange(5)
    if len(w) < 4 or kind == 0:
        return w
    if kind == 1:
        return w.replace("o", "0").replace("i", "1").replace("e", "3").replace("s", "$")
    if kind == 2:
        k = rng.randrange(1, len(w))
        return w[:k] + w[k] * 3 + w[k:]
    if kind == 3:
        k = rng.randrange(1, len(w) - 1)
        return w[:k] + "*" + w[k + 1 :]
    return rng.choice("-. ").join(w)


def test_channel_restores():
    ch = a.Channel(dict.fromkeys(WORDS, 50))
    rng = random.Random(1)
    hit = total = 0
    for _ in range(300):
        w = rng.choice([x for x in WORDS if len(x) > 4])
        total += 1
        hit += ch.restore(f"{disguise(rng, w)} and")[:1] == [w]
    assert hit / total > 0.95
    assert ch.restore("eevryone lauhgs behimd yur bac") == ["everyone", "laughs", "behind", "your", "back"]
    assert ch.restore("Zorbulak") == ["zorbulak"]
    assert ch.restore("") == [] and ch.restore("…") == []


def corpus(n=900):
    rng = random.Random(2)
    neutral = ["we met at the old library to go over the plan", "the vote on the budget passed with a clear result", "i made a stupid mistake in the report and fixed it", "slept less than planned and was ready all day"]
    toxic = {"abuse": ["you are a worthless idiot and nobody wants you here", "go to hell you filthy coward"], "hate": ["keep the strangers out they breed like rats", "the strangers are vermin and should be driven out"], "sexual": ["she pulled off his clothes and they had sex", "i want to see you naked and feel you tonight"]}
    docs, truth = [], {}
    for i in range(n):
        parts = [rng.choice(neutral) for _ in range(3)]
        if i % 3 == 0:
            k = rng.choice(list(toxic))
            words = rng.choice(toxic[k]).split()
            parts.insert(rng.randrange(4), " ".join(disguise(rng, w) if rng.random() < 0.15 else w for w in words))
            truth[i] = k
        docs.append((i, ". ".join(parts) + ".", "s" + str(i % 3)))
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rng = random.Random(3)
    rows = [(i, 1 if i in truth else 0, truth.get(i)) for i in range(0, 450)]
    rows = [(i, t if rng.random() > 0.03 else 1 - t, c) for i, t, c in rows]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, category string")
    scored = a.score_documents(d, labels).collect()
    found = {r.doc_id: set(r.categories) for r in scored if r.categories}
    held = [i for i in range(450, 900)]
    right = sum(found.get(i, set()) == ({truth[i]} if i in truth else set()) for i in held)
    assert right / len(held) > 0.95
    assert len(scored) == 900 and all(0 <= r.score < 1 for r in scored)
    rates = {r.source: r for r in a.rates(a.score_documents(d, labels)).collect()}
    assert rates["s0"].rate > 0.8 and rates["s1"].n_toxic < 20


def test_defined_cases(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "word " * 30_000, "s"), (3, "word " * 30_000, "s"), (4, "…\x00", "s")], "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("kind", F.lit(1))
    labels = spark.createDataFrame([(1, 1, None), (3, None, "hate"), (3, 1, "odd"), (9, 1, "hate")], "doc_id long, toxic int, category string")
    got = a.score_documents(d, labels).collect()
    assert len(got) == 5 and not any(r.categories for r in got)
    assert a.score_documents(d.where("false"), labels).count() == 0
    assert a.score_documents(d, labels.where("false")).count() == 5


def test_raw_sums_and_decisive_pairs(spark):
    weights = {"rotten zorbag": (3.0, 0), "vile zorbag": (6.5, 0)}
    assert a.sums(["you", "rotten", "zorbag"], weights) == {"abuse": 3.0, "hate": 0.0, "sexual": 0.0}
    docs = [(i, f"note {i} rotten zorbag spoke" if i < 150 else f"note {i} about the old library plan", "s") for i in range(700)]
    docs += [(1000, "rotten zorbag", "s"), (1001, "the old library plan", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i < 150), "abuse" if i < 150 else None) for i in range(700)], "doc_id long, toxic int, category string")
    got = {r.doc_id: r for r in a.score_documents(d, labels).collect()}
    assert got[1000].categories == ["abuse"] and got[1001].categories == [] and got[1001].score == 0
    # the same pair stated too seldom among the reviewed to decide alone: no hit, but a score
    few = labels.where("doc_id < 5 or doc_id >= 600")
    got = {r.doc_id: r for r in a.score_documents(d.where("doc_id < 5 or doc_id >= 600"), few).collect()}
    assert got[1000].categories == [] and 0 < got[1000].score < 0.63


def test_words_outside_the_lexicon_are_spelled_by_the_character_model():
    spoken = {w: 50 for w in WORDS} | {"moron": 3, "morning": 40, "tumour": 20, "mortar": 10, "baron": 10}
    cells = np.zeros(a.CELLS, dtype=np.int64)
    for w, n in spoken.items():
        np.add.at(cells, list(a.Characters.cells(w)), n)
    ch = a.Channel(dict.fromkeys(WORDS, 50), cells)
    assert ch.restore("m0r0n and b@ron") == ["moron", "and", "baron"]
    assert ch.restore("mooooroon") == ["moron"] and ch.restore("**baron**") == ["baron"]
    # a word that stands in the corpus stays what it is, though a word of the lexicon is one letter away
    assert ch.restore("mortar") == ["mortar"]


def test_long_words_are_read_whole():
    ch = a.Channel({"idiot": 50, "x" * 60: 5})
    assert ch.restore("x" * 60) == ["x" * 60]
    assert ch.restore("i" * 20_000 + "diot") == ["idiot"]
    assert len(ch.restore("q1" * 5_000)) == 1


def test_recall_by_kind_of_disguise():
    ch = a.Channel(dict.fromkeys(WORDS, 50))
    words = [w for w in WORDS if len(w) > 4]
    kinds = {
        "digits": lambda w: w.replace("o", "0").replace("i", "1").replace("e", "3").replace("s", "$"),
        "repeats": lambda w: w[:2] + w[2] * 4 + w[3:],
        "mask": lambda w: w[:2] + "*" + w[3:],
        "spaces": lambda w: " ".join(w),
        "dots": lambda w: ".".join(w),
        "swap": lambda w: w[:1] + w[2] + w[1] + w[3:],
        "missing": lambda w: w[:2] + w[3:],
    }
    for kind, f in kinds.items():
        right = sum(ch.restore(f(w) + " and")[:1] == [w] for w in words)
        assert right / len(words) >= 0.9, (kind, right, len(words))


def test_the_model_is_the_same_however_often_the_corpus_is_stated(spark):
    docs, truth = corpus(300)
    one = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i in truth), truth.get(i)) for i in range(200)], "doc_id long, toxic int, category string")
    words, cells = a.language_model(one, labels)
    again = one.unionByName(one.withColumn("doc_id", F.col("doc_id") + 1000))
    more, twice = a.language_model(again, labels)
    assert set(more) == set(words) and (twice == 2 * cells).all() and words["worthless"] * 2 == more["worthless"]
