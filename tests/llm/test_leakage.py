import random

from pyspark.sql import functions as F

from loomgraph.llm import leakage as lk

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, n=12):
    runs = lambda t: {tuple(w[k : k + n]) for w in [lk._WORD.findall((t or "").casefold())] for k in range(len(w) - n + 1)}
    index = {i: runs(t) for i, t in items}
    return {(d, i) for d, t in docs for i, r in index.items() if r & runs(t)}


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "it", "word", "longer", "naïve", "Straße", "x1"] + [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(20)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if d % 2:
            src = rng.choice(items)[1].split()
            at, n = rng.randrange(len(src)), rng.randrange(8, 20)
            w[10:10] = src[at : at + n]
        docs.append((d, rng.choice([" ", ", ", " - "]).join(w).upper() if d % 3 else " ".join(w)))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = data(seed)
        want = brute(docs, items)
        got = {(r.doc_id, r.item_id) for r in lk.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
        assert got == want and want


def distance_within(pattern, text):
    """Edits between the pattern and the nearest piece of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edits_against_brute_force(spark):
    """A passage of twelve words with up to two edits, whether letters change, vanish or come in."""
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 40)))) for i in range(8)]
    docs = []
    for d in range(60):
        src = rng.choice(items)[1].split()
        at = rng.randrange(max(1, len(src) - 12))
        piece = list(" ".join(src[at : at + rng.randrange(11, 14)]))
        for _ in range(d % 5):
            k = rng.randrange(len(piece))
            piece[k : k + 1] = rng.choice([[], ["z"], [piece[k], "z"], ["z"]])
        pad = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        docs.append((d, f"{pad()} {''.join(piece)} {pad()}"))
    want = set()
    for d, t in docs:
        flat = lk.flat(t)
        for i, x in items:
            own = lk.flat(x)
            at = [k for k, c in enumerate(own) if c == 32]
            if any(distance_within(own[at[k] : at[k + 12] + 1], flat) <= 2 for k in range(len(at) - 12)):
                want.add((d, i))
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id) for r in lk.leaks(*frames, edits=2).collect()}
    exact = {(r.doc_id, r.item_id) for r in lk.leaks(*frames).collect()}
    assert got == want and exact < got


def test_one_letter_in_every_eleventh_word():
    item = [f"word{k}x" for k in range(40)]
    text = " ".join(w.replace("x", "y") if k % 11 == 5 else w for k, w in enumerate(item))
    index = lk.ItemIndex([(1, " ".join(item))], edits=2)
    assert index.search(text)[0][0] == 40 and not lk.ItemIndex([(1, " ".join(item))]).search(text)


def test_items_in_blocks(spark):
    docs, items = data(4)
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    for edits in (0, 2):
        whole = sorted(map(tuple, lk.leaks(*frames, edits=edits).collect()))
        assert sorted(map(tuple, lk.leaks(*frames, edits=edits, most=500).collect())) == whole
    assert len(lk.item_blocks(frames[1], 500)) > 2


def test_ascii_words_are_the_same_words():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(chr(rng.randrange(128)) for _ in range(60))
        assert lk.flat(t) == (" " + " ".join(w) + " ").encode() if (w := lk._WORD.findall(t.casefold())) else lk.flat(t) == b""


def test_segments_of_a_long_text():
    items = [(1, " ".join(f"q{i}" for i in range(30)))]
    index = lk.ItemIndex(items)
    for shift in (0, 7, 100):
        text = "z " * (lk.SEGMENT // 2 - 60 + shift) + " ".join(f"q{i}" for i in range(5, 20)) + " y" * 500
        assert index.search(text) and index.search(text)[0][0] == 15
    assert not index.search("z " * lk.SEGMENT)


def test_alignment():
    assert lk.align(b"abcdef", b"abXdef", 0, 1) == 6
    assert lk.align(b"abcdef", b"..abdef", 2, 1) == 7
    assert lk.align(b"abcdef", b"abcdef", 0, 0) == 6
    assert lk.align(b"abcdef", b"aXXdef", 0, 1) is None
    assert lk.align(b"abc", b"ab", 0, 1) == 2 and lk.align(b"abc", b"", 0, 2) is None


def test_defined_cases(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (4, item.replace(" ", "  \n"))], DOC).withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], ITEM)
    got = {(r.doc_id, r.item_id) for r in lk.leaks(docs, items).select("doc_id", "item_id").collect()}
    assert got == {(3, 1), (3, 4), (4, 1), (4, 4)}
    assert lk.leaks(docs.where("false"), items).count() == 0
    assert lk.leaks(docs, items.where("false")).count() == 0
