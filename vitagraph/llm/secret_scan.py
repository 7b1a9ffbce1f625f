"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text.  A credential that many owners show is a widely
copied example; one that stays with few owners is specific to them and may be live.  So
the hash of each candidate's value is counted over the corpus by distinct owners and
distinct repositories, and the verdict on a value goes back to each place where it stands.

Three base kinds (assign, access, hex) are reported wherever they occur.  The further
kinds (provider tokens, private keys, passwords in URLs, mixed-case random identifiers)
are reported only where the value looks live: shown by at most ``MAX_OWNERS`` owners and
at most ``MAX_REPOS`` repositories, as one owner may hold a large part of the corpus, and
no stand-in by its own looks (``changeme``, ``xxxxxxxx``, ``your_token_here``).

A private key's span is its whole block, from BEGIN to END, and its value is the body's
key characters, so that re-wrapped, quoted or escaped copies count as one value.  A block
that is cut off before its END goes as far as its key characters do; a header without any
has only itself as its value.

Owners are the ``source`` of a document and repositories its ``doc_id``; a null one counts
as one further owner or repository.  Other columns may be named.

Edge cases: a null text is an empty one; repeated rows of one document don't raise its
counts, as distinct ones count; texts that contain the same value many times get a span
for each place; only the named columns are read, so further ones never clash; an empty
table gives an empty result.  A value that a third of the corpus shows is counted after
partial aggregation by (value, owner), so no task gathers its rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, scoped, ship, tidied

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are dropped here already
#: Further kinds, in the order in which they are listed after the base ones.
FURTHER = (
    ("provider", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{12,}|[sr]k[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,})")),
    ("key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:((?:[^-]|-(?!----))*+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|((?:(?:[\s>|*#\"'+,]|\\[nrt])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nrt])++[A-Za-z0-9+/]{1,15}+(?:={1,2}+|\Z))?))")),
    ("url", re.compile(r"(?<=://)[^\s/:@]{1,64}:[^\s/:@]{4,128}(?=@[A-Za-z0-9])")),
    ("random", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])")),
)
#: A web token is a provider's too.  Its first part may begin within a run of its characters; the run is
#: looked through once, from its start, and not anew from each place within where a part could begin.
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?\beyJ[A-Za-z0-9_-]{8})[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
WEB_START = re.compile(r"\beyJ[A-Za-z0-9_-]{8}")
KINDS = ("assign", "access", "hex", *(k for k, _ in FURTHER))
BASE = 3
#: What is no part of a private key's body: escaped line ends, and characters out of its alphabet.
NO_KEY = re.compile(r"\\[nrt]|[^A-Za-z0-9+/=]")
#: A value of more owners than this is a widely copied example.
MAX_OWNERS = 2
#: So is one of more repositories than this, whoever owns them: a secret may stand in many files of
#: its owner, but seldom in so many.
MAX_REPOS = 50
#: What stands for a secret in examples: such words within a value, or fewer different characters than this.
STAND_IN = re.compile(r"(?ai:change_?me|example|placeholder|dummy|sample|redacted|your[_.-]|_here\b|insert[_.-]|xxxx|\*{4}|\.\.\.)")
FEW = 4


def looks_live(value: str) -> bool:
    """Whether a value may be a real one, by its own looks."""
    return len(set(value)) >= FEW and not STAND_IN.search(value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of every candidate, by start, then kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for k, (kind, pattern) in enumerate(FURTHER, BASE):
        if kind == "key":
            new = [(m.start(), k, m.end(), NO_KEY.sub("", m[1] or m[2] or "") or m[0]) for m in pattern.finditer(text)] if "PRIVATE KEY" in text else []
        else:
            new = [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
        if kind == "provider" and ".eyJ" in text:
            new = _first_ones(new + _web_tokens(text, k))
        if kind == "random" and out:  # what another kind explains is not reported again
            new = _apart(new, out)
        out += new
    out.sort()
    return out


def _web_tokens(text: str, kind: int) -> list[tuple]:
    out = []
    for m in WEB_TOKEN.finditer(text):
        start = WEB_START.search(text, m.start()).start()
        out.append((start, kind, m.end(), text[start : m.end()]))
    return out


def _first_ones(spans: list[tuple]) -> list[tuple]:
    """Spans from left to right, without those that begin within one before them."""
    out: list[tuple] = []
    for x in sorted(spans):
        if not out or x[0] >= out[-1][2]:
            out.append(x)
    return out


def _apart(new: list[tuple], others: list[tuple]) -> list[tuple]:
    """The spans of ``new`` that overlap none of ``others``."""
    ends: list[int] = []  # of the others' union, as disjoint spans in order
    starts: list[int] = []
    for a, _, b, _ in sorted(others):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for x in new:
        at = bisect_left(starts, x[2]) - 1  # the last one that starts before x ends
        if at < 0 or ends[at] <= x[0]:
            out.append(x)
    return out


def cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with spans (start, end), in order of start, replaced; overlapping ones go together."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


CANDIDATES = (
    "doc_id bigint, owner string, repo string, txt string, n_assign bigint, n_access bigint, n_hex bigint, base string,"
    " found array<struct<start:int,kind:int,end:int,value:string,look:boolean>>"
)


def candidates(docs: DataFrame, owner: str = "source", repo: str = "doc_id", key: str = "doc_id") -> DataFrame:
    """One row for each document with its base counts and all candidate spans; values are hashed."""

    def make():
        def step(columns: list[list]) -> list[list]:
            out: list[list] = [columns[0], columns[1], columns[2], columns[3], [], [], [], [], []]
            for text in columns[4]:
                spans = find(text or "")
                for k in range(BASE):
                    out[4 + k].append(sum(s[1] == k for s in spans))
                out[7].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans if k < BASE))
                out[8].append(
                    [
                        {"start": a, "kind": k, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "look": looks_live(v)}
                        for a, k, b, v in spans
                    ]
                )
            return out

        return step

    return arrow_map(
        docs,
        [
            F.col(key).cast("long").alias("doc_id"),
            F.col(owner).cast("string").alias("owner"),
            F.col(repo).cast("string").alias("repo"),
            F.md5("text").alias("txt"),
            F.col("text").cast("string").alias("text"),
        ],
        CANDIDATES,
        make,
    )


def ownership(cands: DataFrame) -> DataFrame:
    """value, owners, repos: distinct owners and repositories that show a candidate value."""
    each = cands.select(F.explode("found").alias("f"), "owner", "repo").select(
        F.col("f.value").alias("value"),
        F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"),
        F.coalesce(F.concat(F.lit("="), "repo"), F.lit("")).alias("repo"),
    )
    owners = each.groupBy("value", "owner").agg(F.lit(1)).groupBy("value").agg(F.count("*").alias("owners"))
    repos = each.groupBy("value", "repo").agg(F.lit(1)).groupBy("value").agg(F.count("*").alias("repos"))
    return owners.join(repos, "value")


def _live(owners: Column, repos: Column, look: Column) -> Column:
    return (owners <= MAX_OWNERS) & (repos <= MAX_REPOS) & look


def _span(s: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """doc_id, txt, base counts, ``base`` (listed base spans) and ``all`` reported spans as an array of
    structs (start, kind, end, value, look, owners, repos), in order."""
    cands = materialize(candidates(docs, owner, repo), "secret-candidates")
    # spans depend on the text alone: verdicts are worked out once for each distinct text
    texts = cands.where(F.size("found") > 0).groupBy("txt").agg(F.first("found").alias("found"))
    each = texts.select("txt", F.explode("found").alias("f")).select("txt", "f.*")
    judged = each.join(ownership(cands), "value").where((F.col("kind") < BASE) | _live(F.col("owners"), F.col("repos"), F.col("look")))
    spans = judged.groupBy("txt").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "look", "owners", "repos"))).alias("all")
    )
    kind = spans.schema["all"].dataType.simpleString()
    with_any = cands.where(F.size("found") > 0).join(spans, "txt", "left")
    without = cands.where(F.size("found") == 0).withColumn("all", F.lit(None).cast(kind))
    both = with_any.unionByName(without)
    return both.withColumn("all", F.coalesce("all", F.array().cast(kind))).drop("found")


@scoped("secret-digests")
def digest(docs: DataFrame) -> DataFrame:
    """The result columns: counts, digest of base spans, all spans, and how many look live or copied."""
    live = lambda s: _live(s["owners"], s["repos"], s["look"])
    return scan(docs).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.transform("all", _span), ",").alias("spans"),
        F.size(F.filter("all", live)).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~live(s))).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span that is no widely copied example replaced by ``mark``.

    Overlapping spans go together.  ``n_chars``, if there, follows the text.
    """
    names = docs.columns
    found = scan(docs)
    live = F.filter("all", lambda s: _live(s["owners"], s["repos"], s["look"]))
    marks = found.select("txt", F.transform(live, lambda s: F.struct(s["start"], s["end"])).alias("cut"))
    marks = marks.where(F.size("cut") > 0).groupBy("txt").agg(F.first("cut").alias("cut"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.md5("text").alias("_txt"))
    hit = row.join(marks.select(F.col("txt").alias("_key"), F.col("cut").alias("_cut")), F.col("_txt") == F.col("_key"), "left")
    at, schema = names.index("text"), docs.schema

    def step(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            columns, cuts = batch.columns[: len(names)], batch.column(len(names))
            hits = pc.indices_nonzero(pc.fill_null(pc.greater(pc.list_value_length(cuts), 0), False)).to_pylist()
            if hits:
                # only the texts that change become Python objects
                new = [cut(columns[at][k].as_py(), [(c["start"], c["end"]) for c in cuts[k].as_py()], mark) for k in hits]
                put = [False] * batch.num_rows
                for k in hits:
                    put[k] = True
                given = {at: new} | ({names.index("n_chars"): [len(t) for t in new]} if "n_chars" in names else {})
                for n, values in given.items():
                    columns[n] = pc.replace_with_mask(columns[n], pa.array(put), pa.array(values, type=columns[n].type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(docs.sparkSession)
    return hit.select(*[F.col("_row").getField(c).alias(c) for c in names], "_cut").mapInArrow(tidied(step), schema)
