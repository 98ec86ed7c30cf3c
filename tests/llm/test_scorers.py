import random
import re

import numpy as np
import pytest

from vecspark.llm import mixing, quality, secrets, toxicity


# ---- toxicity


def toxic_table(spark, n=400):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        y = int(i % 5 == 0)
        if y:
            text[3] = rng.choice(["nasty", "vile"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_held_out_rows_do_not_teach(spark):
    docs, labels = toxic_table(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    from zlib import crc32

    assert all(r["held_out"] == (crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i]["predicted"], int(i % 5 == 0)) for i in got if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    # other labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    teachers = {e["doc_id"] for r in got.values() for e in r["evidence"]}
    assert teachers and not any(got[i]["held_out"] for i in teachers)


def random_index(rng, n, scale):
    """Examples of random terms, the index of them, and each entry's vector."""
    ids = [np.unique(rng.zipf(1.3, rng.integers(1, 12)) % len(scale)).astype(np.int32) for _ in range(n)]
    counts = [rng.integers(1, 4, len(i)).astype(np.int32) for i in ids]
    index, entry = toxicity.BlockMaxIndex.build(ids, counts, (rng.random(n) < 0.3).astype(float), np.arange(n), scale)
    dense = np.zeros((len(index.count), len(scale)))
    for i, c, e in zip(ids, counts, entry):
        dense[e, i] = index.vector(i, c, scale)
    return ids, counts, index, dense


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    ids, counts, index, dense = random_index(rng, 700, rng.random(50) + 0.1)
    assert index.count.sum() == 700 and len(index.count) < 700
    for i, c in zip(ids[:100], counts):
        s = dense[:, i] @ index.vector(i, c, index.scale)
        want = [e for e in np.lexsort((np.arange(len(s)), -s.round(9))) if s[e] > 0][:24]
        found, cosines = index.nearest(i, c)
        assert found.tolist() == want and np.allclose(cosines, s[want])


def test_blocks_out_of_reach_are_not_read(monkeypatch):
    rng = np.random.default_rng(3)
    ids, counts, index, _ = random_index(rng, 4000, rng.random(400) ** 4 + 0.01)
    read = []
    whole = toxicity.BlockMaxIndex._cosines
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_cosines", lambda self, cells, q: read.append(int((self.begin[cells + 1] - self.begin[cells]).sum())) or whole(self, cells, q))
    held = 0
    for i, c in zip(ids[:60], counts):
        index.nearest(i, c)
        held += int((index.begin[index.cells[i + 1]] - index.begin[index.cells[i]]).sum())
    assert sum(read) < 0.7 * held


def slow_scores(docs, labels):
    """The scores of (id, text) rows by dictionaries and loops, from the definitions alone."""
    import math
    from zlib import crc32

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    terms = lambda w: [w] + [w[:n] + "-" for n in (5, 6, 7) if len(w) > n]

    def bag(text):
        out = {}
        for w in words(text):
            for t in terms(w):
                out[t] = out.get(t, 0) + 1
        return out

    bags = {i: bag(t) for i, t in docs}
    learn = [i for i in bags if i in labels and crc32(str(i).encode()) % 4 != 2]
    n, toxic = len(learn), sum(labels[i] for i in learn)
    weight = {}
    for t in {t for i in learn for t in bags[i]}:
        a, b = sum(t in bags[i] for i in learn), sum(t in bags[i] for i in learn if labels[i])
        if a >= 3 and b > 1.5 * toxic / n * a:
            cell = lambda o, e: o * math.log(o / e) if o else 0.0
            lean = cell(b, a * toxic / n) + cell(a - b, a * (1 - toxic / n)) + cell(toxic - b, (n - a) * toxic / n) + cell(n - a - toxic + b, (n - a) * (1 - toxic / n))
            weight[t] = (math.log((1 + len(bags)) / (1 + sum(t in x for x in bags.values()))) + 0.1) * lean**1.5

    def vector(x):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in x.items() if t in weight}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    vectors = {i: vector(x) for i, x in bags.items()}
    entries = {}
    for i in learn:
        if vectors[i]:
            entries.setdefault(tuple(sorted((t, c) for t, c in bags[i].items() if t in weight)), []).append(i)

    number = {t: k for k, t in enumerate(sorted(weight))}  # ties go by the leading terms, then by all of them
    place = lambda f, m: ([number[t] for t in sorted((t for t, _ in f), key=lambda t: (-round(vectors[m[0]][t], 12), number[t]))[:3]], sorted((number[t], c) for t, c in f))
    ordered = [m for _, m in sorted((place(f, m), m) for f, m in entries.items())]

    def nearest(v):
        return sorted(((sum(w * vectors[m[0]].get(t, 0) for t, w in v.items()), m) for m in ordered), key=lambda p: -round(p[0], 9))[:24]

    def vote(v, own=None):
        near = nearest(v)
        up = down = 0.0
        for s, m in near:
            if s > 0:
                m = [i for i in m if i != own]
                up, down = up + s**4 * sum(labels[i] for i in m), down + s**4 * len(m)
        return (up + 0.05 * sum(labels[i] for m in entries.values() for i in m) / sum(map(len, entries.values()))) / (down + 0.05)

    taught = [i for m in entries.values() for i in m]
    knots, values = toxicity.isotonic(np.array([vote(vectors[i], i) for i in taught]), np.array([float(labels[i]) for i in taught]))
    none = [labels[i] for i in learn if not vectors[i]]
    calibrated = lambda v: float(np.interp(vote(v), knots, np.clip(values, 0.001, 0.999)))
    return {i: (calibrated(v), [s for s, _ in nearest(v)[:5] if s > 0]) if v else ((sum(none) + 0.1) / (len(none) + 1), []) for i, v in vectors.items()}


def test_scores_against_plain_loops(spark):
    rng = random.Random(5)
    docs, labels = [], {}
    grey = [a + b for a in ("nasti", "vilen", "grimm", "harsh", "cruel", "mean") for b in ("ly", "ness", "ish", "er", "est", "ful", "")]  # some more toxic than others
    for i in range(260):
        text = [f"w{rng.randrange(8)}" for _ in range(5)] + rng.choices(grey, k=rng.randrange(9))
        docs.append((i, " ".join(text)))
        if i < 220:
            labels[i] = int(rng.random() < 0.1 + 0.8 * (len(text) > 9 and "harshness" in text) + 0.25 * sum(w.startswith(("cruel", "vilen")) for w in text))
    docs += [(400, None), (401, ""), (402, "unknown words only")]
    want = slow_scores(docs, labels)
    table = spark.createDataFrame([(i, y) for i, y in labels.items()], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["score"], [e["cosine"] for e in r["evidence"]]) for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert got.keys() == want.keys() and len({s for s, _ in got.values()}) > 2 and len({round(c, 6) for _, e in got.values() for c in e}) > 50
    assert all(abs(got[i][0] - want[i][0]) < 1e-9 and np.allclose(got[i][1], want[i][1]) for i in want)


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(3)
    x = rng.random(200).round(1)
    y = (rng.random(200) < x).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and np.interp(x, knots, values).mean() == pytest.approx(y.mean())


def test_toxicity_edges(spark, edges, empty):
    docs, labels = toxic_table(spark, 60)
    got = toxicity.score(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)
    assert toxicity.score(empty, labels).count() == 0
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert len(none) == 60 and len({r["score"] for r in none}) == 1
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, odd).count() == 60


def test_toxicity_knows_all_beginnings_and_many_terms(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        text = [f"word{rng.randrange(60)}" for _ in range(30)]
        if i % 5 == 0:  # five letters in common and no more
            text[3] = "snarl" + rng.choice("abcdefghijklmnopqrstuvwxyz") + str(i)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in toxicity.score(docs, labels).collect() if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    many = spark.createDataFrame([(" ".join(f"t{j}" for j in range(1500)) if i < 10 else "other", int(i < 10)) for i in range(50)], "text string, toxic int")
    assert len(toxicity.choose_terms(many)) == 1500
    many = spark.createDataFrame([(" ".join(f"t{j}" for j in range(30_000)) if i < 4 else "other", int(i < 4)) for i in range(20)], "text string, toxic int")
    assert len(toxicity.choose_terms(many)) == 30_000 + 2_000  # and the five-letter beginnings of t10000 to t29999


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = (np.array([r["score"] for r in got if r["toxic"] == y]) for y in (1, 0))
    assert len(toxic) > 50 and np.mean(toxic >= toxicity.THRESHOLD) > 0.85 and np.mean(clean >= toxicity.THRESHOLD) < 0.06
    assert np.mean(toxic[:, None] > clean[None]) + np.mean(toxic[:, None] == clean[None]) / 2 > 0.95


# ---- quality


def test_em_recovers_labellers_accuracies():
    rng = np.random.default_rng(4)
    n, m = 6000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    catches = np.linspace(0.3, 0.8, m)
    votes = np.where(good[:, None], np.where(rng.random((n, m)) < 0.01, 0, 1), np.where(rng.random((n, m)) < catches, 0, 1))
    votes[rng.random((n, m)) < 0.2] = quality.NONE
    patterns = {}
    keys = ["".join(map(str, v)) for v in votes]
    for k in keys:
        patterns[k] = patterns.get(k, 0) + 1
    share, table, posterior = quality.estimate(patterns)
    assert abs(share[1] - 0.8) < 0.05
    assert np.abs(table[:, 0, quality.BAD] - catches).max() < 0.1
    assert np.mean([(posterior[k] > 0.5) == g for k, g in zip(keys, good)]) > 0.93
    assert quality.estimate({})[2] == {}


def test_quality_against_a_run_without_spark(spark, edges):
    """The same steps on lists: votes, their counts, posteriors, training, scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).union(edges.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    patterns = {}
    for _, t in rows:
        v = quality.votes(t)
        patterns[v] = patterns.get(v, 0) + 1
    _, _, posterior = quality.estimate(patterns)
    h = quality.Hasher()
    first = {}
    for i, t in rows:
        if i is not None:
            ids, x = h(t)
            first[i] = min(first.get(i, ([1 << 30],)), (ids.tolist(), x.tolist(), quality.votes(t)))
    w = quality.train([(np.array(i), np.array(x), y) for i, x, y in sorted((i, x, posterior[v]) for i, x, v in first.values())])
    want = []
    for i, t in rows:
        ids, x = h(t)
        z = float(x @ w[ids] + w[-1])
        want.append((i is None, i or 0, quality.votes(t), round(posterior[quality.votes(t)], 9), round(1 / (1 + np.exp(-z)), 9) if (t or "").split() else 0.0))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["votes"], round(r["posterior"], 9), round(r["score"], 9)) for r in quality.classify(docs).collect()]
    assert sorted(got) == sorted(want)


def slow_votes(text):
    """The labellers from their descriptions, a word at a time."""
    words = (text or "").split()
    n = len(words)
    share = lambda f: sum(map(f, words)) / n
    lower = lambda w: all(c.isalpha() and c.islower() for c in w)
    between = lambda x, bad, good: 0 if x >= bad else 1 if x <= good else 2
    ends = share(lambda w: w[-1] in ".,;:" and w[:-1].isalpha())
    plain = share(lambda w: w[0].isalpha() and (len(w) < 3 or lower(w[1:-1])))
    few = len(set(words)) / min(n, 400)
    return "".join(map(str, (
        between(share(lambda w: re.search(r"[#$%&*@~^=<>{}\\]{2,}|[!?]{2,}", w) is not None), 0.15, 0.02), between(share(lambda w: len(w) > 1 and w.isupper()), 0.3, 0.05),
        between(share(lambda w: not any(c.isalnum() for c in w)), 0.12, 0.02), between(sum(a == b for a, b in zip(words, words[1:])) / n, 0.2, 0.06),
        1 if 0.03 <= ends <= 0.4 else 0 if n >= 40 and ends < 0.01 else 2, 2 if n < 50 else 0 if few < 0.15 else 1 if few > 0.3 else 2, 1 if plain >= 0.9 else 0 if plain < 0.6 else 2)))


def test_votes_against_slow_ones(documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    texts = [t for t in texts if len((t or "").split()) >= quality.FEW_WORDS]
    assert len(texts) > 500 and [quality.votes(t) for t in texts] == [slow_votes(t) for t in texts]


def test_quality_against_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(documents).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.2


def test_quality_edges(edges, empty):
    got = quality.classify(edges).collect()
    assert len(got) == edges.count()
    assert all(r["score"] == 0 and not r["kept"] for r in got if r["doc_id"] in (3, 4, 5))
    assert quality.classify(empty).count() == 0
    kept = quality.survivors(edges)
    assert kept.columns == edges.columns
    n = lambda rows: sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)
    assert n(kept.collect()) == n(r for r in got if r["kept"])


# ---- mixing


def test_rates_reach_the_targets_and_match_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 100, 200)
    members = spark.createDataFrame([(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(n, p))], "doc_id long, tokens long, posterior array<double>")
    goal = [0.5, 0.3, 0.2]
    got = mixing.fit_rates(members, goal, steps=200).orderBy("doc_id").collect()
    rate = np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and np.allclose((p * (n * rate)[:, None]).sum(0) / n.sum(), goal, atol=2e-3)
    r, w = np.ones(200), 1 / ((p * n[:, None]).sum(0) / n.sum())
    for _ in range(5000):
        now = (p * (n * r)[:, None]).sum(0) / n.sum()
        r = np.maximum(0, r + 0.3 * ((w * (goal - now)) @ p.T + mixing.PULL * (1 - r)))
    assert np.abs(rate - r).mean() < 0.05


def test_a_scarce_domain_reaches_its_target(spark):
    goal = [0.5, 0.2, 0.18, 0.12]
    domain = np.repeat([0, 1, 2, 3], [500, 300, 190, 10])
    for soft in (0.0, 0.15):
        p = np.full((1000, 4), soft / 4) + (1 - soft) * np.eye(4)[domain]
        members = spark.createDataFrame([(i, 50, q.tolist()) for i, q in enumerate(p)], "doc_id long, tokens long, posterior array<double>")
        got = mixing.fit_rates(members, goal).orderBy("doc_id").collect()
        share = np.array([r["rate"] for r in got]) @ p / 1000
        assert np.abs(share - goal).max() < 2e-3 and np.allclose(share - goal, got[0]["residual"], atol=1e-9)


def test_unreachable_targets_stop_at_zero(spark):
    members = spark.createDataFrame([(0, 10, [1.0, 0.0]), (1, 10, [0.0, 1.0])], "doc_id long, tokens long, posterior array<double>")
    rate = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(members, [0.0, 1.0]).collect()}
    assert rate[0] < 0.02 and rate[1] == pytest.approx(2, abs=0.02)


def test_mixing_edges(spark, edges, empty):
    got = mixing.mix(edges).collect()
    assert len(got) == edges.count() and all(r["copies"] >= 0 and r["rate"] >= 0 for r in got)
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    assert mixing.mix(empty).count() == 0
    rows = mixing.mixed(edges)
    assert rows.columns == edges.columns
    assert rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix(edges.withColumn("lang", edges["lang"].substr(9, 1))).count() == edges.count()  # no known domain


def test_posteriors_against_plain_loops(spark):
    import math
    from zlib import crc32

    rng = random.Random(9)
    words = {"a": ["uno", "dos", "tres"], "b": ["one", "two", "three"]}
    docs = [(i, d, " ".join(rng.choices(words[d] + ["x"], k=rng.randrange(0, 50)))) for i in range(60) for d in (rng.choice("ab"),)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in mixing.mix(df, {"a": 0.5, "b": 0.5}).collect()}
    counts = {d: [0.2] * mixing.FEATURES for d in "ab"}
    hashed = lambda t: [crc32(w.encode()) % mixing.FEATURES for w in t.split()]
    for _, d, t in docs:
        for h in hashed(t):
            counts[d][h] += 1
    for i, _, t in docs:
        h = hashed(t)
        logs = [sum(math.log(counts[d][x] / sum(counts[d])) for x in h) * (min(len(h), 30) / len(h) if h else 0) for d in "ab"]
        e = [math.exp(s - max(logs)) for s in logs]
        assert got[i]["tokens"] == len(h) and np.allclose(got[i]["posterior"], [v / sum(e) for v in e])


def test_targets_of_zero_are_equal_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b", "uno dos" if i < 40 else "one two") for i in range(50)], "doc_id long, lang string, text string")
    rows = [mixing.mix(df, t).collect() for t in ({"a": 0.0, "b": 0.0, "c": 1.0}, {"a": 0.5, "b": 0.5})]
    assert sorted(r["rate"] for r in rows[0]) == sorted(r["rate"] for r in rows[1])
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0, "b": 2.0})


def test_mixture_on_documents(documents):
    from pyspark.sql import functions as F

    rows = mixing.mixed(documents)
    words = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    total = sum(words.values())
    assert all(abs(words[k] / total - v) < 0.03 for k, v in mixing.TARGETS.items())


# ---- secrets


def brute_base(text):
    """The contract's patterns, matched by hand from each place in turn."""
    out = []
    head = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, p, ok in (("assign", head, lambda m: len(m[1]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        at = 0
        while m := p.search(text, at):
            at = m.end()
            if ok(m):
                out.append((m.start(), m.end(), k))
    return out


CASES = [
    "PassWord: 'hunter2222' x", "token=abc", "token = short api_key=\"AbCdEf123\"", "API-KEY=abcdef", "AKIA" + "A1" * 8, "AKIAabc AKIA" + "Z" * 30, "deadbeef" * 3, "deadbeef" * 2,
    "\U0001f600 secret:deadbeefdeadbeefdeadbeefdead", "password:token: abcdefgh", "ſecret=abcdefgh", "", "x" * 5000 + " token=abcdefg",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    want = sorted(brute_base(text), key=lambda s: (s[0], order[s[2]]))
    assert [s for s in secrets.spans(text) if s[2] in secrets.KINDS[:3]] == want


def test_base_spans_of_documents(documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    for t in texts:
        got = [s for s in secrets.spans(t) if s[2] in secrets.KINDS[:3]]
        assert sorted(got) == sorted(brute_base(t))
    assert any(secrets.spans(t) for t in texts)


def test_weak_parts_need_their_complements():
    key = "AKIA" + "Q7" * 8
    opaque = "wJ4lrXUtnFEMI7K9MDENGbPx"
    kinds = lambda t: {k for _, _, k in secrets.spans(t)}
    assert kinds(f"{key} and {opaque}") == {"access", "value"}
    assert kinds(opaque) == set() and kinds("user = alice") == set() and kinds("see https://example.com/a") == set()
    assert kinds(f"{key} {'word ' * 60} {opaque}") == {"access"}  # out of scope
    assert kinds(f"host: db.example.com user: alice password: s3cretpass") == {"assign", "identifier", "endpoint"}
    assert kinds("https://db.example.com password: s3cretpass") == {"assign"}


def test_opaque_values_may_be_long():
    for n in (128, 129, 5000):
        value = ("aB3dE5gH7" * n)[:n]
        text = f"user=someone then {value} end"
        assert [(k, text[a:b]) for a, b, k in secrets.spans(text)] == [("identifier", "user=someone"), ("value", value)]


def test_a_part_is_not_its_own_complement():
    for text in ("user=abcdefg123456789", "client_id=myapp0001 something", "key_id: abcDEF123ghiJKL456==", "https://user1234abcd:pass5678efgh@db.example.com/x"):
        assert secrets.spans(text) == []


ATOMS = [
    "user=alice", "login: bob99", 'client_id="myapp0001xyzQ77aa"', "key_id=" + "Zz9" * 8, "https://db.example.com/a?b=1", "host: db.internal:5432", "postgres://u:p4ssw0rd99xyzABC12@h/db",
    "password = hunter2222", "token:abc", "AKIA" + "Q7" * 8, "deadbeef" * 3, "wJ4lrXUtnFEMI7K9MDENGbPx", "aaaaaaaaaaaaaaaaaaaa", "aB3dE5gH7kL9mN1pQ==", "word", "日本語 \U0001f600", "=", "x" * 30, "\n", "\"", "12345678901234567890",
]


def slow_spans(text, scope):
    """Every weak part against every other part, from the patterns' own matches."""
    base = brute_base(text)
    apart = lambda x, y: x[1] <= y[0] or y[1] <= x[0]
    near = lambda x, y: apart(x, y) and max(x[0] - y[1], y[0] - x[1]) < scope
    parts = [(m.start(), m.end(), k) for k, p in (("identifier", secrets.IDENTIFIER), ("endpoint", secrets.ENDPOINT)) for m in p.finditer(text)]
    parts = [x for x in parts if all(apart(x, b) for b in base)]
    values = [(m.start(), m.end(), "value") for m in secrets.OPAQUE.finditer(text) if secrets._opaque(m[0])]
    parts += [v for v in values if all(apart(v, x) for x in base + [p for p in parts if p[2] == "identifier"])]
    out = base + [x for x in parts if all(any(y[2] in group and near(x, y) for y in base + parts) for group in secrets.NEEDS[x[2]])]
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def test_spans_match_a_slow_interval_join():
    rng = random.Random(6)
    linked = 0
    for _ in range(400):
        text = "".join(rng.choice(ATOMS) + rng.choice([" ", "", "  ", ", "]) for _ in range(rng.randrange(1, 14)))
        for scope in (1, 10, 40, secrets.SCOPE):
            got = secrets.spans(text, scope)
            assert got == slow_spans(text, scope)
            linked += sum(s[2] in secrets.KINDS[3:] for s in got)
    assert linked > 500


def test_sql_gives_the_same_spans(spark):
    import duckdb

    rng = random.Random(8)
    docs = [(i, "".join(rng.choice(ATOMS) + rng.choice([" ", "", "  ", ", "]) for _ in range(rng.randrange(1, 14))) + " " + "pad " * rng.randrange(80) + rng.choice(ATOMS)) for i in range(300)] + [(300, None), (301, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    want = {r[0]: r[1:] for r in con.execute(secrets.ORACLE).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in secrets.scan(table).collect()}
    assert got == want and sum(r[-1] for r in got.values()) > 50


def test_scan_edges(edges, empty):
    got = secrets.scan(edges).collect()
    assert len(got) == edges.count() and secrets.scan(empty).count() == 0
    import hashlib

    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got if r["doc_id"] in (3, 4, 5))
