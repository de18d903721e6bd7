import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import nbsvm, toxicity

from .conftest import DOCS, made_text


def labelled(spark, spoil, n=600):
    rnd = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        t, bad = made_text(rnd, rnd.choice([20, 60, 120])), i % 4 == 0
        rows.append((i, spoil(t, i, rnd) if bad else t, "en", "s", 0))
        marks.append((i, 0 if bad else 1, 1 if bad else 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def junk(t, i, rnd):
    return " ".join(w + "###" for w in t.split(" ")) if i % 8 else " ".join([t.split(" ")[0]] * 40)


def insult(t, i, rnd):
    w = t.split(" ")
    for _ in range(2):
        term = rnd.choice(["blockhead", "nitwittery", "dunderpate"])
        if i % 12 == 0:  # misspelled
            k = rnd.randrange(1, len(term) - 1)
            term = term[:k] + rnd.choice("qzx") + term[k + 1 :]
        w.insert(rnd.randrange(len(w)), term)
    return " ".join(w)


def test_quality_held_out(spark):
    docs, labels = labelled(spark, junk)
    got = nbsvm.score(docs, nbsvm.train(docs, labels)).collect()
    assert len(got) == 600
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    kept = nbsvm.score(docs, nbsvm.train(docs, labels), keep=True)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_never_sees_held_out_labels(spark):
    docs, labels = labelled(spark, junk, 200)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    one, two = nbsvm.train(docs, labels), nbsvm.train(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, insult)
    model = toxicity.train(docs, labels)
    matcher = toxicity.Matcher(model.terms, model.stems)
    assert all(matcher[t] in (1, 2) for t in ("blockhead", "nitwittery", "dunderpate"))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    plain = [r for r in held if r["doc_id"] % 12]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in plain]) > 0.97
    misspelled = [r for r in held if r["doc_id"] % 12 == 0]
    assert np.mean([r["score"] for r in misspelled]) > np.mean([r["score"] for r in plain if r["doc_id"] % 4])


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_awkward(module, awkward_docs, empty_docs, labels, no_labels):
    for lab in (labels, no_labels):
        for train_on in (awkward_docs, empty_docs):
            model = module.train(train_on, lab)
            rows = module.score(awkward_docs, model).collect()
            assert len(rows) == awkward_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert module.score(empty_docs, model).count() == 0


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_clashing_columns(module, awkward_docs, labels):
    plain = [repr(r) for r in module.score(awkward_docs, module.train(awkward_docs, labels)).collect()]
    docs, marks = awkward_docs, labels
    for c in ("y", "f", "score", "held_out", "predicted", "w", "t", "m"):
        docs, marks = docs.withColumn(c, F.lit("clash")), marks.withColumn(c, F.lit(7))
    marks = marks.withColumn("text", F.lit("clash"))
    assert sorted(plain) == sorted(repr(r) for r in module.score(docs, module.train(docs, marks)).collect())
    if module is nbsvm:
        assert module.score(docs, module.train(docs, marks), keep=True).columns == docs.columns


def edit_distance(a, b):
    """Letters inserted, dropped or replaced and neighbours swapped; a swapped pair isn't edited again."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_misspelled_words_against_distances():
    """What the matcher calls misspelled, by brute force over the terms: one edit from five letters on, two from nine."""
    rnd = random.Random(9)
    terms = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 12))) for _ in range(40)})
    m = toxicity.Matcher(terms, [])
    for _ in range(1500):
        t = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(t))
            t[k : k + 1] = rnd.choice([[], [rnd.choice("abcd")], [t[k], rnd.choice("abcd")], t[k : k + 2][::-1][:1]]) or ["a"]
        w = "".join(t)
        near = any(edit_distance(w, x) <= (2 if len(x) >= 9 else 1) for x in terms if len(x) >= 5)
        assert m[w] == (1 if w in terms else 3 if near else 0), w


PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", '"': '"'}


def words_and_quotes(text):
    """(words, whether each is quoted), letter by letter: a mark ends the last open one that it may end, else it may begin one."""
    items = []
    for line in (text or "").split("\n"):
        word, open_, marked = "", [], []
        for i, ch in enumerate(line + " "):
            if ch.isalnum():
                word += ch
                continue
            if word:
                marked.append([word, False])
                word = ""
            if ch in "’‘" and 0 < i < len(line) - 1 and line[i - 1].isalpha() and line[i + 1].isalpha():
                continue
            ends = [k for k, (m, _) in enumerate(open_) if ch in PAIRS[m]]
            if ends:
                for w in marked[open_[ends[-1]][1] :]:
                    w[1] = True
                open_ = open_[: ends[-1]]
            elif ch in PAIRS:
                open_.append((ch, len(marked)))
        items += marked
    return [w for w, _ in items], [q for _, q in items]


def test_quotations_against_pairs_by_hand():
    rnd = random.Random(12)
    for _ in range(800):
        text = "".join(rnd.choice(["a", "bc", " ", " ", "’", "‘", '"', "“", "”", "„", "«", "»", "‚", ".", "1", "\n"]) for _ in range(rnd.randint(0, 40)))
        tokens = toxicity.TOKEN.findall(text)
        words, quoted = words_and_quotes(text)
        assert [t for t in tokens if t not in toxicity.MARKS] == words and toxicity.quoted_words(tokens) == quoted, text


def test_apostrophes_and_other_quotations_do_not_quote():
    m = toxicity.Matcher(["idiot"], [])
    for text in ("You’re an idiot and you don’t know it", 'She said "hi" and he is an idiot, then "bye"', "“hi” idiot “bye”", "the ‘90s idiot", "»a« idiot »b«", '"one\nidiot" two'):
        assert toxicity.features(text, m)[3] > 0, text
    assert toxicity.features("You’re an idiot and you don’t know it", m)[6] == toxicity.features("You're an idiot and you don't know it", m)[6]
    for text in ('he said "you idiot" there', "„Du idiot“ sagte er", "« un idiot »", "»so ein idiot«", "‘an idiot’, they wrote", "“a ‘real’ idiot”"):
        assert toxicity.features(text, m)[3] == 0 and toxicity.features(text, m)[0] > 0, text


def test_no_term_is_dropped_by_count(spark):
    """More distinct terms than any list was ever cut to."""
    rnd = random.Random(2)
    names = [f"{a}{b}{c}x" for a in "bcdfghjklmnp" for b in ("ar", "el", "im", "on", "ut") for c in (f"{i:03d}" for i in range(120))]
    rows, half = [], [names[i : i + 360] for i in range(0, len(names), 360)]
    for i in range(6 * len(half)):
        w = list(half[i % len(half)])
        rnd.shuffle(w)
        rows.append((i, 1, " ".join(w)))
    rows += [(10_000 + i, 0, "calm words only here") for i in range(400)]
    terms, stems = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, y int, text string"))
    assert len(names) > 5000 and set(names) == set(terms) | {n for n in names if any(n.startswith(s) for s in stems)}


def plain_places(text):
    """Feature places in plain integers."""
    top = 1 << 64
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    words = (text or "").encode().split()
    w = [xxhash.xxh64_intdigest(x.lower()) for x in words]
    s = [xxhash.xxh64_intdigest(nbsvm.shape(x.decode()).encode(), 7) ^ (c if i and w[i] == w[i - 1] else 0) for i, x in enumerate(words)]
    n = len(words)
    g = [x * a % top for x in w] + [(x * b + 1) % top for x in s]
    g += [((w[i] * a % top ^ w[i + 1]) * c + 2) % top for i in range(n - 1)] + [((s[i] * b % top ^ s[i + 1]) * a + 3) % top for i in range(n - 1)]
    g += [(((s[i] * b % top ^ s[i + 1]) * a % top ^ s[i + 2]) * c + 4) % top for i in range(n - 2)]
    return sorted({(x ^ x >> 31) * b % top >> 64 - nbsvm.BITS for x in g})


def test_quality_scores_against_plain_python(spark):
    """Features, log-count ratios, the dual descent and the scores of a small table, recomputed with lists and dicts."""
    docs, labels = labelled(spark, junk, 60)
    more = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "One ONE one a-b-c-d-e-f-g-h 12,5 Éa", "en", "s", 0)], DOCS)
    docs = docs.unionByName(more)
    model = nbsvm.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    ids = sorted(y)
    rows = {i: plain_places(t) for i, t in texts.items()}
    good, bad = sum(y.values()), len(y) - sum(y.values())
    pos, neg = {}, {}
    for i in ids:
        for f in rows[i]:
            (pos if y[i] else neg)[f] = (pos if y[i] else neg).get(f, 0) + 1
    ratio = {f: np.log((pos.get(f, 0) + 1) / (good + 2)) - np.log((neg.get(f, 0) + 1) / (bad + 2)) for f in {*pos, *neg} if pos.get(f, 0) + neg.get(f, 0) >= 3}
    w, bias, alpha = {}, 0.0, dict.fromkeys(ids, 0.0)
    rng = np.random.default_rng(5)
    for _ in range(8):
        most = 0.0
        for at in rng.permutation(len(ids)):
            i = ids[at]
            k, sign, box = len(rows[i]) ** -0.5, 2 * y[i] - 1, len(ids) / (2 * (good if y[i] else bad))
            v = {f: ratio[f] * k for f in rows[i] if f in ratio}
            new = alpha[i] - (sign * (sum(w.get(f, 0) * x for f, x in v.items()) + bias) - 1) / (sum(x * x for x in v.values()) + 1)
            new = min(max(new, 0), box)
            d, alpha[i] = (new - alpha[i]) * sign, new
            for f, x in v.items():
                w[f] = w.get(f, 0) + d * x
            bias += d
            most = max(most, abs(d))
        if most < 1e-3:
            break
    mean = np.mean([abs(x) for x in w.values() if abs(x) > 1e-12])
    weight = {f: (0.25 * mean + 0.75 * w.get(f, 0)) * r for f, r in ratio.items()}
    margin = {i: sum(weight.get(f, 0) for f in fs) / max(len(fs), 1) ** 0.5 + bias for i, fs in rows.items()}
    for i in texts:
        assert abs(got[i] - 1 / (1 + np.exp(-(model.a * margin[i] + model.b)))) < 1e-4, i
    assert got[900] == got[901]


def test_whole_shapes_are_features():
    assert nbsvm.shape("a-b-c-d-e-f-g-h") != nbsvm.shape("a-b-c-d-e-f-!!") and nbsvm.shape("http://Ab.c/12345?x=yyy") == "x://Xx.x/9?x=x"


def score_by_hand(text, model):
    """Features and score of a text, in plain Python."""
    tokens, inside = words_and_quotes(text)

    def kind(w):
        w = w.lower()
        if w in model.terms:
            return 1
        if any(w.startswith(s) for s in model.stems):
            return 2
        return 3 if any(edit_distance(w, t) <= (2 if len(t) >= 9 else 1) for t in model.terms if len(t) >= 5) else 0

    kinds = [kind(t) for t in tokens]
    n, free, best, m = [0, 0, 0], [0, 0, 0], 0.0, 8
    for i, k in enumerate(kinds):
        if not k:
            continue
        around, quoted = range(max(0, i - m), min(len(tokens), i + 1 + m)), inside[i]
        words = {tokens[j].lower() for j in around}
        w = (0.4 if quoted else 1) * (0.7 if quoted and words & toxicity.REPORTING else 1) * (1.2 if words & toxicity.ADDRESS else 1)
        w *= 1 + 0.5 * min(2, sum(1 for j in around if kinds[j]) - 1)
        n[k - 1] += 1
        free[k - 1] += not quoted
        best = max(best, w * (0.5 if k == 3 else 1))
    x = [*np.log1p(n), *np.log1p(free), best, np.log1p(100 * sum(n) / max(1, len(tokens))), float(n[0] + n[1] > 0)]
    z = float(((np.array(x) - model.mean) / model.scale) @ model.weights + model.bias)
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force(spark):
    docs, labels = labelled(spark, insult, 200)
    more = ["", None, 'he said "blockhead" there', "you blockhead, you nitwittery", "blokchead", "nitwitetry here", "“dunderpate” she wrote", "a " * 3000 + "dunderpate"]
    docs = docs.unionByName(spark.createDataFrame([(900 + i, t, "en", "s", 0) for i, t in enumerate(more)], DOCS))
    model = toxicity.train(docs, labels)
    assert model.weights.min() >= 0 and model.terms
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        assert abs(got[r["doc_id"]] - score_by_hand(r["text"], model)) < 1e-9
    assert got[904] > got[900] and got[905] > got[900]  # a swap of neighbours is a misspelling


def test_automaton_against_distances():
    rnd = random.Random(3)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(40)})
    trie = toxicity.Trie.of(terms, [])
    for _ in range(400):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
        for k in (1, 2):
            near = min((edit_distance(w, t), i) for i, t in enumerate(terms))
            got = trie.within(w, k)
            assert (got is None) == (near[0] > k), (w, k)
            assert got is None or got[1] == near[0]


def test_stems_and_quotes():
    m = toxicity.Matcher(["blockhead"], ["dund"])
    assert m["Blockhead"] == 1 and m["dunderpate"] == 2 and m["blockhaed"] == 3 and m["blohekcad"] == 0 and m["blokhead"] == 3 and m["fine"] == 0
    insult_ = toxicity.features("you are a blockhead", m)
    quoted = toxicity.features('he wrote "you are a blockhead" in it', m)
    assert insult_[6] > quoted[6] and insult_[3] > quoted[3] == 0


def test_dual_solution_is_optimal():
    """The hinge-loss primal at the dual solution: no small change of the weights improves it."""
    rng = np.random.default_rng(0)
    x = (rng.random((60, 8)) < 0.4).astype(float)
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0.5, 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in x]
    w, b = nbsvm.dual_coordinate_descent(rows, np.ones(8), y, np.ones(60), 500, 1)
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    primal = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    for _ in range(200):
        assert primal(w + 0.02 * rng.standard_normal(8), b + 0.02 * rng.standard_normal()) > best - 1e-2
