"""The trie of rebuilt conversations, against a plain one built in one piece."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """All nodes, from the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for conv in own:
        own[conv].sort()
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        paths[conv] = [(t[3], t[4]) for t in own.get(base, [])[:h] + turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(paths):
        for d in range(len(paths[conv]) + 1):
            members[tuple(paths[conv][:d])].append(conv)
        ends[tuple(paths[conv])].append(conv)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        out.append(
            (
                convs[0],
                len(node),
                members[node[:-1]][0] if node else None,
                len(convs),
                children[node],
                sum(not children[x] for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x),
                hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(spark, rows, extra=True):
    from vitagraph.llm.conversation_trie import prefix_trie

    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        df = df.selectExpr("*", "1 AS base", "'x' AS key", "2 AS words", "'y' AS node", "3 AS n")
    made = prefix_trie(df)
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, made.collect()), key=str)


def corpus(rng, ids, longest, texts):
    rows = []
    for conv in ids:
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(["user", "a", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


TEXTS = ["one two three", "four", "", None, "a b\tc d e"]


@pytest.mark.parametrize("seed", [0, 2])
def test_against_a_plain_trie(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-70, 140), 90)
    rows = corpus(rng, ids, 7, TEXTS[: 2 + seed])
    rows += [(None, 0, "user", "no conversation"), *rows[:5]]
    assert got(spark, rows) == plain(rows)


def test_long_conversations_in_pieces(spark, monkeypatch):
    from vitagraph.llm import conversation_trie

    monkeypatch.setattr(conversation_trie, "PIECE", 4)
    monkeypatch.setattr(conversation_trie, "BLOCK", 1)
    for seed in (0, 1):
        rng = random.Random(10 + seed)
        rows = corpus(rng, range(0, 45, 1 + seed), 6, TEXTS)
        # copies of long conversations, one cut off, ones that part late
        long = [(t, "user", rng.choice(TEXTS)) for t in range(23)]
        for conv, upto in ((0, 23), (20, 23), (40, 17), (47, 23), (48, 9), (61, 23)):
            rows = [r for r in rows if r[0] != conv] + [(conv, *x) for x in long[:upto]]
        rows += [(47, 30, "user", "other end"), (200, None, None, None)]
        assert got(spark, rows) == plain(rows)


def test_edges(spark):
    from vitagraph.llm.conversation_trie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], COLUMNS)).count() == 0
    long = "word " * 100_000
    rows = [(0, 0, "user", long), (1, 0, "user", long), (2, 0, None, None), (20, 0, "user", long)]
    assert got(spark, rows) == plain(rows)


def test_a_family_sends_each_node_once(spark):
    """A third of all conversations are copies: their nodes are a row for each family."""
    from vitagraph.llm.conversation_trie import _families, family_trie, turns

    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(6)] + [(c, t, "user", f"{c} {t}") for c in range(400, 1200) for t in range(2)]
    from pyspark.sql import functions as F

    nodes = _families(turns(spark.createDataFrame(rows, COLUMNS)).withColumn("more", F.lit(False)))
    copied = nodes.where("conv_id < 400").groupBy("node").count().collect()
    assert len(copied) >= 7 and max(r["count"] for r in copied) == 20
    assert got(spark, rows, extra=False) == plain(rows)
    trie = family_trie(0, [(0, True, 0, b"a", 1, False), (20, True, 0, b"a", 1, False)])
    assert trie[0].n == 2 and trie[0].up == -1


def test_query_against_its_sql(spark):
    import duckdb

    from vitagraph.llm.queries import OP11_SQL, op11_conversation_trie

    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    df = op11_conversation_trie(spark, data)
    cur = con.execute(OP11_SQL)
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cur.fetchall(), key=str)
