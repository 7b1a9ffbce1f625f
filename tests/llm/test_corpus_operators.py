"""Operators that relate rows: mixing, near copies, Jaccard join, URL rules, components, the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from helpers import AWKWARD, docs, nullified

# --- components ------------------------------------------------------------------


def closure(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    from vitagraph.llm.components import components

    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(50, j) for j in range(51, 80)] + [(rng.randrange(100, 150), rng.randrange(100, 150)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure(150, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing ----------------------------------------------------------------------


def plain_targets(sizes):
    """Caps one round after another, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, left = sum(sizes.values()), {}, set(order)
    while left:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in left)
        share = {s: rest * weight[s] / w for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        if not above:
            return {**out, **share}
        out |= {s: 3 * sizes[s] for s in above}
        left -= above
    return out


def test_mix_against_plain_targets(spark):
    from vitagraph.llm.curriculum_mix import mix, plan

    rng = random.Random(2)
    names = ["b", "a", None, "ü", "Z", "tiny", "zz", "a"]
    texts, sources = [], []
    for _ in range(600):
        s = "hot" if rng.random() < 0.35 else rng.choice(names)
        texts.append("w " * (1 if s == "tiny" else rng.randrange(0, 40)))
        sources.append(s)
    texts += AWKWARD
    sources += [None] * len(AWKWARD)
    df = docs(spark, texts, sources)
    df = nullified(df.unionByName(df.limit(3)))  # repeated rows, and nulls everywhere
    rows = plan(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, plan(df.repartition(3)).collect()))
    out = mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["passes"] for r in rows)
    at = sorted(p for r in rows for p in r["positions"])
    assert at and at[0] >= 0 and at[-1] <= 1
    assert plan(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0


def curve(knots, t):
    """Integral of the piecewise linear weight up to t, by many small steps."""
    x = (np.arange(200_000) + 0.5) / 200_000
    y = np.interp(x, [k for k, _ in knots], [w for _, w in knots])
    return float(y[x < t].sum() / y.sum())


@pytest.mark.parametrize("given", [None, [(0.0, 3.0), (0.25, 0.0), (0.5, 0.0), (0.6, 2.0)], [(0.5, 1.0)], [(0.2, 0.0), (0.8, 4.0)]])
def test_positions_invert_the_demand(spark, given):
    from pyspark.sql import functions as F

    from vitagraph.llm.curriculum_mix import pieces, position

    sources = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "src string, rk int")
    knots = {"a": [(0.0, 1.5), (1.0, 0.5)], "b": [(0.0, 1.0), (1.0, 1.0)], None: [(0.0, 0.5), (1.0, 1.5)]}
    schedule = None
    if given:
        knots[None] = given
        odd = [("b", 0.5, float("nan")), ("b", 2.0, 1.0), ("b", 0.1, -1.0), ("a", 0.3, 0.0), (None, given[0][0], 0.0), ("other", 0.1, 1.0)]
        schedule = spark.createDataFrame([(None, t, w) for t, w in given] + odd, "source string, t double, weight double")
    table = pieces(sources, schedule)
    for src in knots:
        for y in (0.0, 0.1, 0.5, 0.77, 1.0):
            got = table.where(F.col("src").eqNullSafe(F.lit(src))).select(position(F.lit(y * 80), F.lit(80.0), F.col("pieces")).alias("t")).first()["t"]
            assert curve(knots[src], got) == pytest.approx(y, abs=2e-5) and 0 <= got <= 1


def test_mix_of_one_id(spark, monkeypatch):
    """All rows share one id; many of them are equal."""
    from pyspark.sql import functions as F

    from vitagraph.llm import curriculum_mix as C

    monkeypatch.setattr(C, "COPIES", 1000)
    n = 100_000
    text = F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(F.concat(F.lit("a b "), F.col("id").cast("string")))
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))
    got = C.plan(df).agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("copies").alias("c"), F.countDistinct("positions").alias("d")).first()
    assert (got["n"], got["t"], got["c"], got["d"]) == (n, 3 * n, n // 3 + 1, n)
    assert C.mix(df).groupBy("text").count().agg(F.count("*"), F.max("count")).first()[:] == (n - n // 3, n // 3 + 1)


# --- embeddings --------------------------------------------------------------------


def test_embeddings_against_all_pairs(spark):
    from vitagraph.llm.cross_polytope import near_duplicates

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    near = base[:80] + rng.normal(size=(80, 24)) * 0.22
    hot = base[5] + rng.normal(size=(120, 24)) * 0.25
    x = np.vstack([base, near, hot, base[:6], 3 * base[6:8]])
    labels = [int(v) for v in np.concatenate([np.arange(300) % 3, np.arange(80) % 3, np.full(120, 5 % 3), np.arange(6) % 3, np.arange(6, 8) % 3])]
    rows = [(i, [float(np.float32(v)) for v in x[i]], labels[i]) for i in range(len(x))]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [1.0, None], 1), (905, rows[0][1], None), (906, rows[0][1][:8], 0), (None, rows[1][1], labels[1])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS cid", "2 AS bucket")
    got = {r["vec_id"]: r for r in near_duplicates(df).collect()}
    ids = [i for i, _, _ in rows] + [906, None]
    vecs = [np.array(v) for _, v, _ in rows] + [np.array(odd[6][1]), np.array(odd[7][1])]
    labs = labels + [0, labels[1]]
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(ids)), 2)
        if labs[a] == labs[b] and len(vecs[a]) == len(vecs[b]) and vecs[a] @ vecs[b] / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b]) >= 0.93
    ]
    n = [0] * len(ids)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= n[k] for k, i in enumerate(ids))
    assert found >= 0.99 * 2 * len(links) and len(links) > 500
    if found == 2 * len(links):
        root = closure(len(ids), links)
        least = {}
        for k, i in enumerate(ids):
            least[root[k]] = min(least.get(root[k], 10**9), 10**9 if i is None else i)
        assert all(got[i]["component_id"] == least[root[k]] for k, i in enumerate(ids))
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert near_duplicates(df.limit(0)).count() == 0


def test_blocks_lose_nothing(spark, monkeypatch):
    from vitagraph.llm import cross_polytope as C

    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + rng.normal(size=(90, 16)) * 0.15
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(90)], "vec_id bigint, embedding array<double>, label int")
    whole = sorted(C.near_duplicates(df).collect())
    monkeypatch.setattr(C, "BLOCK", 40)
    assert sorted(C.near_duplicates(df).collect()) == whole


def test_recall_of_hashing():
    from vitagraph.llm import cross_polytope as C

    rng = np.random.default_rng(5)
    for largest in (1_000, 100_000, 10_000_000):
        hashes, tables, probes = C.shape_for(largest)
        a = rng.normal(size=(1500, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (b * a).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        y = 0.93 * a + np.sqrt(1 - 0.93**2) * b
        x, z = C.codes(a, hashes, tables, probes), C.codes(y, hashes, tables, probes)
        met = ((x[:, :, :1] == z) | (z[:, :, :1] == x)).any(axis=(1, 2))
        assert met.mean() >= 0.99


@pytest.mark.parametrize("dim", [16, 128, 384])
def test_recall_in_other_dimensions(dim):
    from vitagraph.llm import cross_polytope as C

    rng = np.random.default_rng(dim)
    a = rng.normal(size=(1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    y = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    for size in (1_000, 100_000, 10_000_000):
        shape = C.shape_for(size, dim)
        x, z = C.codes(a, *shape), C.codes(y, *shape)
        assert ((x[:, :, :1] == z) | (z[:, :, :1] == x)).any(axis=(1, 2)).mean() >= 0.97
    u, v = C.signs(a).view(np.uint64), C.signs(y).view(np.uint64)
    assert (np.bitwise_count(u ^ v).sum(axis=1) <= C.NEAR_BITS).all()


def test_shapes_differ_by_label_and_do_not_change_links(spark, monkeypatch):
    from vitagraph.llm import cross_polytope as C

    rng = np.random.default_rng(9)
    rows = []
    for label, n in ((1, 12), (2, 150), (3, 40)):
        base = rng.normal(size=(n // 2, 32))
        for v in np.vstack([base, base + rng.normal(size=base.shape) * 0.1]):
            # one of the labels holds doubles that floats would round
            rows.append((len(rows), [float(c if label == 3 else np.float32(c)) for c in v], label))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = sorted(C.near_duplicates(df).collect())
    links = [0] * len(rows)
    for (i, a, k), (j, b, m) in itertools.combinations(rows, 2):
        if k == m and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[j] += 1
    assert [r["n_links"] for r in whole] == links and sum(links) >= len(rows) - 5
    # labels of one and of two hashes; small groups in blocks of matrices; joins by shuffle
    monkeypatch.setattr(C, "shape_for", lambda size, dim: (1, 3, 3) if size < 100 else (2, 12, 6))
    monkeypatch.setattr(C, "SMALL", 2)
    monkeypatch.setattr(C, "BROADCAST_ROWS", -1)
    assert sorted(C.near_duplicates(df).collect()) == whole


# --- Jaccard join -------------------------------------------------------------------


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_join(ids, texts, k=4, percent=85):
    sets = [shingles(t, k) for t in texts]
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(ids)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = closure(len(ids), links)
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, 10**9), 10**9 if i is None else i)
    return {(i, len(s), least[r] if least[r] < 10**9 else None) for i, s, r in zip(ids, sets, root, strict=True)}


def family(rng, vocabulary, n, members, edits):
    base = [rng.choice(vocabulary) for _ in range(n)]
    out = []
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(n)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def corpus(rng):
    vocabulary = [f"v{i}" for i in range(300)] + ["Ünï", "ABC", "abc"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [t for n, m, e in ((30, 12, 3), (80, 25, 5), (200, 10, 12), (9, 15, 1)) for t in family(rng, vocabulary, n, m, e)]
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(80)]
    texts += [passage + " " + str(i) for i in range(20)]
    texts += [texts[0]] * 30 + [texts[3].upper(), texts[3].lower()] + AWKWARD
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_against_all_pairs(spark, monkeypatch, small):
    from vitagraph.llm import jaccard_pivots as J

    if small:  # frequent shingles, short spares, blocks everywhere
        for name, value in (("HOT", 4), ("SLACK", 2), ("BLOCK", 5), ("PIVOTS", 3), ("VERIFY", 4), ("BROADCAST_KEYS", 1), ("BROADCAST_REGIONS", 1)):
            monkeypatch.setattr(J, name, value)
    texts = corpus(random.Random(6))
    df = docs(spark, texts)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(df).collect()}
    assert got == plain_join(list(range(len(texts))), texts)


def test_jaccard_edges(spark):
    from vitagraph.llm import jaccard_pivots as J

    df = nullified(docs(spark, ["a b c d e f", "a b c d e f", None, ""]))
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(df).collect()]
    assert sorted(rows, key=str) == sorted([(0, 3, 0), (1, 3, 0), (2, 0, 2), (3, 0, 3), (None, 0, None)], key=str)
    assert J.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 85])
def test_cells_lose_no_pair(percent):
    """Every pair within reach meets in exactly one leaf, whatever the pivots cut."""
    from vitagraph.llm import jaccard_pivots as J

    rng, limit = np.random.default_rng(11), J.Limit(percent)
    heads = rng.integers(0, 2, (20, 256)).astype(bool)
    rows = np.concatenate([h ^ (rng.random((40, 256)) < rng.uniform(0, 0.15)) for h in heads])
    size = rng.integers(130, 256, len(rows))
    code = np.packbits(rows, axis=1).view(np.uint64)
    outer = rng.integers(0, 2, len(rows))
    seen, work = {}, 0
    for k, o in J._leaves(code, size, outer, limit):
        work += len(k)
        for pair in zip(np.minimum(k, o).tolist(), np.maximum(k, o).tolist(), strict=True):
            seen[pair] = seen.get(pair, 0) + 1
    far = (rows[:, None] ^ rows[None]).sum(2)
    want = {
        (a, b)
        for a, b in zip(*np.nonzero(limit.apart(far, size[:, None], size[None]) & limit.sizes(size[:, None], size[None])), strict=True)
        if a < b and not outer[a] & outer[b]
    }
    assert len(want) > 1000 and all(seen.get(p) == 1 for p in want)
    assert max(seen.values()) == 1 and (percent < 80 or work < len(rows) ** 2 / 6)


def test_rings():
    from vitagraph.llm.jaccard_pivots import Limit

    for percent in (40, 80, 85):
        limit = Limit(percent)
        for a, b in itertools.combinations_with_replacement(range(1, 300), 2):
            if 100 * a >= percent * b:
                assert limit.rings(a)[0] in limit.rings(b)


def test_parity_bound():
    from vitagraph.llm import jaccard_pivots as J

    rng = np.random.default_rng(7)
    for _ in range(50):
        x, y = (set(rng.integers(0, 2**62, rng.integers(1, 400)).tolist()) for _ in range(2))
        common = set(list(x)[: len(x) // 2])
        y |= common
        bits = []
        for s in (x, y):
            k = J.PARTS << max(0, (J.PARITIES * len(s) - 1) // J.PARTS).bit_length()
            count = np.bincount(np.array(list(s)) & (k - 1), minlength=k)
            bits.append(np.packbits((count & 1).astype(bool), bitorder="little"))
        assert J._distance(*bits) <= len(x ^ y)


# --- URL rules -----------------------------------------------------------------------


def test_fixed_rules(spark):
    from vitagraph.llm.url_rules import judge

    urls = [
        "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "https://example.com/fr/", "http://x.net/es/1", "http://net/fr/",
        "http://x.net/de/1", "http://a.com", "no scheme", None, "x://h?q/es/", "http://notcom/", "http://user@b.com:80/p#://z", "a://b://c/d",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS toks")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judge(df).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/"), 1: ("www.example.com", "/en/", "www.example.com/en/"), 2: ("example.com", "/fr/", "com/"),
        3: ("x.net", "/es/1", "net/es/"), 4: ("net", "/fr/", "net/fr/"), 5: ("x.net", "/de/1", None), 6: ("a.com", "", None), 7: ("", "", None),
        8: ("", "", None), 9: ("h", "", None), 10: ("notcom", "/", None), 11: ("user@b.com:80", "/p", None), 12: ("b:", "//c/d", None),
    }
    verdicts = {r["page_id"]: r["verdict"] for r in judge(df).collect()}
    assert verdicts[1] == verdicts[2] == "allow" and verdicts[0] == verdicts[3] == "block"
    assert judge(df.limit(0)).count() == 0


def test_mined_rules_against_enumeration(spark):
    """Every rule and verdict, from all token combinations of the labelled URLs."""
    from pyspark.sql import functions as F

    from vitagraph.llm import url_rules as U

    rng = random.Random(8)
    urls = []
    for i in range(400):
        host = rng.choice(["a.com", "b.net", "shop.example.com", "blog.org", "x.net"])
        urls.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}{rng.choice(['', '?ref=1', '#t', '.html'])}")
    how = U.Mining(min_support=0.05, min_confidence=0.7)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    host, path = U.split_url(F.col("url"))
    full = df.withColumn("h", host).withColumn("p", path)
    rows = full.select("page_id", U.tokens(F.col("url"), F.col("h"), F.col("p")).alias("t"), U.fixed_rule(F.col("h"), F.col("p")).alias("f")).collect()
    labelled = [(frozenset(r["t"]), r["f"]["verdict"]) for r in rows if r["f"]]
    n = len(labelled)
    counts, hits = {}, {}
    for toks, verdict in labelled:
        for k in (1, 2, 3):
            for combo in itertools.combinations(sorted(toks), k):
                counts[combo] = counts.get(combo, 0) + 1
                hits[combo, verdict] = hits.get((combo, verdict), 0) + 1
    rules = {key: (c / counts[key[0]], c / n) for key, c in hits.items() if c >= np.ceil(how.min_support * n) and c / counts[key[0]] >= how.min_confidence}
    weaker = {
        (combo, v)
        for (combo, v), (conf, _) in rules.items()
        for k in range(1, len(combo))
        for sub in itertools.combinations(combo, k)
        if rules.get((sub, v), (0, 0))[0] >= conf - 1e-12
    }
    rules = {k: v for k, v in rules.items() if k not in weaker}
    got = {(tuple(r["antecedent"]), r["verdict"]) for r in U.mine(full.select(U.tokens(F.col("url"), F.col("h"), F.col("p")).alias("toks"), U.fixed_rule(F.col("h"), F.col("p")).alias("f")).where("f is not null").select("toks", F.col("f.verdict").alias("verdict")), how).collect()}
    assert got == set(rules)
    default = "block" if sum(v == "block" for _, v in labelled) * 2 > n else "allow"
    judged = {r["page_id"]: r["verdict"] for r in U.judge(df, how=how).collect()}
    for r in rows:
        if r["f"]:
            assert judged[r["page_id"]] == r["f"]["verdict"]
            continue
        fit = [(conf, sup, v == "block", v) for (combo, v), (conf, sup) in rules.items() if set(combo) <= set(r["t"])]
        if fit:
            top = max(x[:2] for x in fit)
            assert judged[r["page_id"]] in {x[3] for x in fit if np.allclose(x[:2], top)}
        else:
            assert judged[r["page_id"]] == default


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_against_plain_steps(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import zstandard

    import corpus_pipeline as P
    from vitagraph.llm import compression_bands as C
    from vitagraph.llm import secret_scan as S
    from vitagraph.llm.piece_codec import PieceEncoder, model_path

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = [t for _ in range(12) for t in family(rng, vocabulary, 90, 4, 4)]
    secret = "token = '" + "q7Zx9" * 4 + "'"
    texts = [t + (f" {secret}" if i % 9 == 0 else "") for i, t in enumerate(texts)] + ["same words " * 80] + AWKWARD
    df = docs(spark, texts, sources=[f"s{i % 4}" for i in range(len(texts))], extra=False)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    press = zstandard.ZstdCompressor(level=C.LEVEL).compress
    keep = [i for i, t in enumerate(texts) if not (C.measure(t).base_failed or C.verdict((t or "").encode(), press)[2])]
    comp = {i: c for i, _, c in plain_join(keep, [texts[i] for i in keep], 5, 80)}
    keep = [i for i in keep if comp[i] == i]
    owners = {f"s{i % 4}" for i in keep if secret in texts[i]}
    clean = {}
    for i in keep:
        t = texts[i]
        for a, _, b, _ in reversed(S.find(t)):
            t = t[:a] + "[SECRET]" + t[b:] if len(owners) <= S.MAX_OWNERS else t
        clean[i] = t
    sizes = {}
    for i in keep:
        sizes[f"s{i % 4}"] = sizes.get(f"s{i % 4}", 0) + len(clean[i].split())
    target = plain_targets(sizes)
    times = {}
    for s in sizes:
        start = 0
        layout = lambda i: hashlib.md5(f"{i}:{hashlib.md5(clean[i].encode()).hexdigest()}".encode()).hexdigest()
        for i in sorted((i for i in keep if f"s{i % 4}" == s), key=layout):
            n = len(clean[i].split())
            times[i] = sum(start + n / 2 + r * sizes[s] < target[s] for r in range(3))
            start += n
    codec = PieceEncoder(model_path())
    sha = lambda t: hashlib.sha256(codec.model.decode(codec.encode(t)).encode()).hexdigest()
    want = sorted((i, len(codec.encode(clean[i])), sha(clean[i])) for i in keep for _ in range(times[i]))
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want and len(P.STAGES) == 5


def test_pipeline_stages_on_awkward_rows(spark):
    """Extra columns with clashing names, nulls in every column, repeated rows, empty tables."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = [t for _ in range(4) for t in family(rng, vocabulary, 90, 3, 2)] + AWKWARD
    df = nullified(docs(spark, texts))
    df = df.unionByName(df.limit(4)).unionByName(df.limit(1).selectExpr(*[f"'other' AS {c}" if c == "lang" else c for c in df.columns]))
    ids = {}
    for name, stage in P.STAGES:
        out = stage(spark, df, "")
        assert stage(spark, df.limit(0), "").count() == 0
        if name != P.STAGES[-1][0]:
            assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        ids[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    every = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    assert ids["secret scans"] == ids["SentencePiece encoding and decoding"] == every
    copies = plain_join(list(range(len(texts))), texts, 5, 80)
    want = {(False, c) for _, _, c in copies} | {(True, 0)}
    assert ids["n-gram Jaccard join"] == sorted(want)
    assert P.near_copies(spark, df, "").where("doc_id = 0").collect() == P.near_copies(spark, df.repartition(7), "").where("doc_id = 0").collect()
    good = {i for i, t in enumerate(texts) if len((t or "").split()) >= 50 and i < 12}
    assert good <= {i for _, i in ids["quality rules"]}
