import random
import re

import numpy as np

from framelark.llm import near_dedup
from framelark.llm.shingles import shingle_set, word_hashes

from .conftest import BASE, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs of rows."""
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)], d is None or d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, docs=None):
    docs = docs or spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    return got


def test_odd_texts(spark, odd_texts, odd_docs):
    check(spark, odd_texts, odd_docs)


def mutate(text, rate, r):
    return " ".join(w if r.random() > rate else f"m{r.randrange(10**6)}" for w in text.split())


def group(n_words, first):
    """A hub with many mutated copies, chains, exact copies and a passage that many share."""
    r = random.Random(n_words)
    hub, passage = words(n_words, 5 + first), words(n_words // 2, 6 + first)
    rows = [(first + k, mutate(hub, r.choice([0, 0.01, 0.03, 0.06, 0.1]), r)) for k in range(120)]
    rows += [(first + 1000 + k, passage + " " + words(n_words // 3, 50 + k)) for k in range(40)]
    chain = hub.split()
    for k in range(30):
        chain = chain[: -max(1, n_words // 12)] + [f"c{k}_{j}" for j in range(n_words // 12)] if k % 2 else [f"d{k}_{j}" for j in range(max(1, n_words // 15))] + chain[max(1, n_words // 15) :]
        rows.append((first + 2000 + k, " ".join(chain)))
    return rows + [(first + 3000 + k, rows[3][1]) for k in range(20)]


def test_groups_of_copies(spark):
    rows = group(60, 0) + group(150, 10_000) + group(500, 20_000)
    random.Random(1).shuffle(rows)
    check(spark, rows)


def template(n, seed=0, slots=9, choices=35, size=108):
    """Documents of one template, nine words of which vary."""
    r = random.Random(seed)
    frame = [f"t{i}" for i in range(size)]
    rows = []
    for k in range(n):
        own = list(frame)
        for j in range(slots):
            own[6 + j * (size // slots)] = f"s{j}_{r.randrange(choices)}"
        rows.append((k, " ".join(own)))
    return rows


def stages(spark, rows):
    """Rows that each step on contested members makes, and those verified at last."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    keep = {name: getattr(near_dedup, name) for name in ("met", "verified")}

    def counted(name):
        def run(*args):
            made = keep[name](*args)
            seen.setdefault(name, []).append((args[0] if name == "verified" else made).count())
            return made

        return run

    for name in keep:
        setattr(near_dedup, name, counted(name))
    try:
        near_dedup.near_duplicates(docs).collect()
    finally:
        for name, f in keep.items():
            setattr(near_dedup, name, f)
    return seen


def test_templates_do_not_give_all_pairs(spark, monkeypatch):
    few, many = stages(spark, template(150)), stages(spark, template(300))
    assert many["verified"][-1] <= 2 * few["verified"][-1] + 10
    monkeypatch.setattr(near_dedup, "SPLIT_COST", 1)  # lists split already at this size
    split = stages(spark, template(300))
    assert split["met"][-1] < many["met"][-1] / 2 and split["verified"][-1] == many["verified"][-1]
    check(spark, template(120, seed=3, choices=3))


def test_exact(spark):
    rows = group(60, 0) + group(300, 20_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(docs, exact=True).collect()), key=str) == brute(rows)


def test_growing_lists_find_every_pair():
    """Every similar pair has an entry in common at any depth, whatever its classes."""
    r = np.random.default_rng(4)
    for _ in range(300):
        k = int(r.integers(2, 9))
        weights, has = r.integers(1, 6, k), r.random((2, k)) < 0.8
        sets = [np.flatnonzero(h) for h in has]
        n = [int(weights[s].sum()) for s in sets]
        common = int(weights[has.all(axis=0)].sum())
        if not common or 175 * common < 75 * sum(n):
            continue
        slack = [m // 4 for m in n]
        level = [[(0, -1, 0, 0)] for _ in sets]
        for _ in range(k + 1):
            made = []
            for side in (0, 1):
                each = [near_dedup._grown(*e[:4], slack[side], sets[side].astype(np.int64), weights[sets[side]].astype(np.int64)) for e in level[side]]
                made.append({(int(np.uint64(key).astype(np.int64)), bool(done)): (int(np.uint64(key).astype(np.int64)), int(at), int(left), int(got)) for own in each for key, at, left, got, _, _, done in zip(*own)})
            same = set(made[0]) & set(made[1])
            assert same
            if any(done for _, done in same):
                break
            level = [[m[s] for s in same] for m in made]
        else:
            raise AssertionError("no end")


def test_boundary_of_75(spark):
    """Similarities of exactly, just under and just over 0.75."""
    base = [f"b{i}" for i in range(304)]  # 300 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:229])), (3, " ".join(base[:228])), (4, " ".join(base[:230] + ["x"]))]
    got = {r[0]: r[2] for r in check(spark, rows)}
    assert got[1] == got[2] == 1


def test_hashes():
    text = "The  quick\tbrown\x0bfox\rjumps over the lazy dog " * 3
    assert len(shingle_set(text)) == len(brute_set(text))
    assert (shingle_set(text) == shingle_set(text.upper())).all()
    assert len(word_hashes("A a\x1fb".encode(), fold=False)) == 2
    assert not (shingle_set("é x") == shingle_set("É x")).all()
    assert len(np.intersect1d(shingle_set(BASE), shingle_set(BASE + " more"))) == 16
    assert len(shingle_set("a b")) == 1 and not len(shingle_set(None)) and not len(shingle_set(" \n"))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_long_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words and their complements collide under any polynomial modulo 2**64."""
    swap = str.maketrans("ab", "ba")
    for n in (8, 16, 64, 65, 1024, 4096):
        one = thue_morse(n)
        assert not (word_hashes(one.encode()) == word_hashes(one.translate(swap).encode())).any(), n
    long = thue_morse(4096)
    check(spark, [(1, f"{BASE} {long}"), (2, f"{BASE} {long.translate(swap)}"), (3, long), (4, long.translate(swap))])


def test_long_text_in_pieces(monkeypatch):
    from framelark.llm import shingles

    text = words(3000, 9)
    whole = shingle_set(text)
    monkeypatch.setattr(shingles, "PIECE", 257)
    assert (shingle_set(text) == whole).all()


def test_empty(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.accept(no_docs).count() == 0


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == got[1000] == 1000


def test_accept_by_row(spark):
    other = words(90, 77)
    rows = [(1, BASE, 1), (2, BASE + " twentyone", 1), (2, other, 1), (3, other + " end", 1), (4, words(70, 8), 1), (4, words(70, 8), 1), (5, None, 1), (5, None, 1), (5, words(60, 9), 1), (5, words(60, 10), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    got = sorted(((r.doc_id, r.text) for r in near_dedup.accept(docs).collect()), key=str)
    fives = [g for g in got if g[0] == 5]
    assert [g for g in got if g[0] != 5] == sorted([(1, BASE), (2, other), (4, words(70, 8))], key=str)
    assert fives.count((5, None)) == 2 and len(fives) >= 3


def test_accept(odd_docs):
    kept = near_dedup.accept(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 5 in ids and ids.count(None) == 2
