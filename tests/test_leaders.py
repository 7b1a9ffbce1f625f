"""Resolution in order against a plain loop over candidates."""

import random

import pytest

WORDS = ["ba", "co", "di", "fu", "ge", "ha", "ji", "ko", "lu"]
CANDIDATES = "cand_id int, pos long, id string, name string, type string"


def canon(name):
    return " ".join(w for w in "".join(c if c.isalnum() else " " for c in (name or "").lower()).split())


def loop(candidates, nodes, threshold=0.82):
    """Nodes: [id, name, type, aliases].  Returns found, new ids, aliases by id, and the nodes."""
    entries = [[i, n, t, list(a)] for i, n, t, a in nodes]
    found, new, aliases = {}, [], []

    def sim(a, b):
        a, b = set(canon(a).split()), set(canon(b).split())
        return len(a & b) / len(a | b) if a | b else 1.0

    for cand, _, given, name, type_ in sorted(candidates, key=lambda c: c[1]):
        given = (given or "").strip() or None
        if given and any(e[0] == given for e in entries):
            found[cand] = (given, "id")
            continue
        best, at = 0.0, None
        for e in entries:
            if e[2] == type_:
                score = max(1.0 if canon(f) == canon(name) else sim(f, name) for f in [e[1], *e[3]])
                if score >= threshold and score > best:
                    best, at = score, e
        if at:
            home = next(e for e in entries if e[0] == at[0])
            if name.strip() and canon(name) not in {canon(f) for f in [home[1], *home[3]]}:
                home[3].append(name.strip())
                aliases.append((home[0], name.strip()))
            found[cand] = (at[0], "match")
        else:
            id_ = given if given and ":" in given else "ga:" + (canon(name).replace(" ", "-") or "node")
            if not any(e[0] == id_ for e in entries):
                new.append(id_)
            entries.append([id_, name, type_, []])
            found[cand] = (id_, "new")
    return found, sorted(new), sorted(aliases)


def graph_of(spark, nodes):
    from vitagraph import graph

    rows = [(k, i, t, n, a) for k, (i, n, t, a) in enumerate(nodes)]
    node = spark.createDataFrame(rows, "ord long, id string, type string, name string, aliases array<string>")
    none = spark.createDataFrame([], "id string")
    return graph.build(spark, node, none, none.selectExpr("id", "id AS claim", "0L AS ev_ord"), none)


def run(spark, candidates, nodes):
    from vitagraph.operators.leaders import grown, resolve_in_order

    g = graph_of(spark, nodes)
    r = resolve_in_order(spark.createDataFrame(candidates, CANDIDATES), g)
    found = {x["cand_id"]: (x["node_id"], x["how"]) for x in r.found.collect()}
    return found, sorted(x["id"] for x in r.nodes.collect()), sorted((x["id"], x["alias"]) for x in r.aliases.collect()), grown(g, r)


def name(rng, least, most):
    return " ".join(rng.sample(WORDS, rng.randrange(least, most)))


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_loop(spark, seed):
    rng = random.Random(seed)
    words = (5, 9) if seed % 2 else (1, 8)
    nodes = [(f"ga:n{k}", name(rng, *words), rng.choice(["drug", "scale"]), [name(rng, *words)] * (k % 2)) for k in range(5)]
    ids = [None, None, None, "ga:n1", "X:1", "X:2", "nocolon", " "]
    cands = [(k, k * 3, rng.choice(ids) if seed > 1 else None, rng.choice([name(rng, *words), name(rng, *words).upper(), "(!)"]), rng.choice(["drug", "scale"])) for k in range(60)]
    # the id of a node that is there, taken by a new name
    cands += [(500, 7, None, "n1", "tool"), (501, 8, None, "n1", "tool"), (502, 9, "ga:n1", "other", "tool")]
    found, new, aliases, g = run(spark, cands, nodes)
    want = loop(cands, nodes)
    assert found == want[0] and new == want[1] and aliases == want[2]
    assert {h for _, h in found.values()} >= {"new", "match"}
    assert g.node.count() == len(nodes) + len(new)
    got = {r["id"]: set(r["aliases"]) for r in g.node.collect()}
    for id_, alias in aliases:
        assert alias in got[id_] or any(alias.lower() == x.lower() for x in got[id_])


def test_chains_and_ties(spark):
    nine = WORDS
    chain = [(k, k, None, " ".join(f"w{j}" for j in range(k, k + 12)), "drug") for k in range(6)]
    random.Random(1).shuffle(chain)
    ties = [(100 + k, 100 + k, None, " ".join(w for j, w in enumerate(nine) if j != k % 9), "scale") for k in range(9)]
    cands = chain + ties + [(200, 300, None, " ".join(nine), "scale"), (201, 301, None, " ".join(reversed(nine)), "scale")]
    found, new, aliases, _ = run(spark, cands, [])
    assert (found, new, aliases) == loop(cands, [])


def test_edges(spark):
    found, new, aliases, g = run(spark, [(0, 0, None, "ba", "drug")], [])
    assert found == {0: ("ga:ba", "new")} and new == ["ga:ba"] and not aliases
    from vitagraph.operators.leaders import resolve_in_order

    r = resolve_in_order(spark.createDataFrame([], CANDIDATES), g)
    assert r.found.count() == r.nodes.count() == r.aliases.count() == 0


def test_common_words_join_nothing(spark):
    """100,000 names with six words in common: pairs met stay few, as they meet on their rarest word."""
    from pyspark.sql import functions as F

    from vitagraph.operators import link

    ids = spark.range(100_000)
    common = "ba co di fu ge ha"
    nodes = ids.select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("id"), F.lit("drug").alias("type"), F.concat(F.lit(common + " word"), "id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    cands = nodes.select(F.col("ord").alias("cand_id"), F.concat("name", F.lit("s")).alias("name"), "type", "aliases")
    got = link.best_match(cands, nodes)
    assert got.where(F.col("node_id") == F.concat(F.lit("n"), "cand_id")).count() == 100_000


def test_of_one_name_two_candidates_are_looked_at(spark, monkeypatch):
    """Many candidates of few names: the work on names is on two of each, and all become what one by one they would."""
    from vitagraph.operators import leaders

    names = ["ba co", "ba  co!", "ba co di fu ge", "ba co di fu ge ha", "X!", ""]
    rows = [(k, 1000 - k, "pt:1" if k % 50 == 0 else None, names[k % 6], "drug") for k in range(700)]
    seen, classes = [], leaders._classes
    monkeypatch.setattr(leaders, "_classes", lambda c: (seen.append(c.count()), classes(c))[1])
    got, new, aliases, _ = run(spark, rows, [("ga:x", "Other", "drug", [])])
    assert seen == [2 * 6 + 14]
    want = loop(sorted(rows, key=lambda r: r[1]), [("ga:x", "Other", "drug", [])])
    assert got == want[0] and new == want[1] and aliases == want[2]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.82, 1.0])
def test_near_pairs_are_all_found(spark, threshold):
    from vitagraph.operators import link

    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    make = lambda: [(f"{k}", rng.choice(["drug", "outcome"]), rng.sample(words[:9] if k % 3 else words, rng.randint(0, 9 if k % 3 else 24))) for k in range(160)]
    left, right = make(), make()
    right += [(f"c{k}", t, (toks + ["more"])[1:]) for k, (_, t, toks) in enumerate(left) if toks]
    frame = lambda rows: spark.createDataFrame(rows, "key string, type string, toks array<string>")
    got = {(r["l"], r["r"]): round(r["sim"], 9) for r in link.near_pairs(frame(left), frame(right), threshold).collect()}
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b): round(sim(x, y), 9) for a, t, x in left for b, u, y in right if t == u and x and y and sim(x, y) >= threshold}


def test_names_of_middling_words_meet_few(spark):
    """Words that many names have, none of them rare: names meet those that they are near to, not all that share a word or two."""
    from vitagraph.operators import link

    common = [f"common{k}" for k in range(6)]
    names = [(f"{a}-{b}-{c}-{d}", "drug", [*common, f"a{a}", f"b{b}", f"c{c}", f"d{d}"]) for a in range(6) for b in range(6) for c in range(6) for d in range(10)]
    left = spark.createDataFrame([(k, t, [*toks, "x"]) for k, t, toks in names], "key string, type string, toks array<string>")
    right = spark.createDataFrame(names, "key string, type string, toks array<string>")
    assert link.meetings(left, right, 0.82).count() < 25 * len(names)
    assert link.near_pairs(left, right, 0.82).count() == len(names)
