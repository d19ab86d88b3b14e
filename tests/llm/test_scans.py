"""Secret scans and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

from factorloom.llm import chat, queries, secrets
from tests.llm.conftest import DOCS, rows

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_secrets(data):
    out = {}
    for d, t in data:
        t = t or ""
        by = {
            "assign": [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6],
            "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
            "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24],
        }
        base = sorted((s, n, f"{k}:{s}:{e}") for n, (k, v) in enumerate(by.items()) for s, e in v)
        more = [(s, 3 + n, f"{r.kind}:{s}:{e}") for n, r in enumerate(secrets.MORE_RULES) for s, e in (m.span() for m in re.finditer(r.pattern, t, r.flags))]
        out[d] = {"doc_id": d, **{f"n_{k}": len(v) for k, v in by.items()}, "base_sha256": sha(",".join(x[2] for x in base)), "spans": ",".join(x[2] for x in sorted([*base, *more]))}
    return out


EXTRA = [
    (100, "-----BEGIN RSA PRIVATE KEY----- x -----BEGIN PRIVATE KEY-----"), (101, "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln eyJhbGciOiJI"), (102, "ghp_" + "a1B2" * 9 + " gho_short"),
    (103, "see postgres://me:hunter22@db/x and http://a:b@c"), (104, "PASSWD:xxxxxx apikey=123456 API_KEY='12345' toKen  ==  abcdef"), (105, "AKIA" * 20), (106, "AKIAAKIA" + "é" * 30 + "deadbeef" * 4),
]


def test_secret_digests(spark, docs, empty):
    assert rows(secrets.secret_digests(docs)) == brute_secrets(DOCS)
    assert rows(secrets.secret_digests(spark.createDataFrame(EXTRA, "doc_id long, text string"))) == brute_secrets(EXTRA)
    assert secrets.secret_digests(empty).count() == 0
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(secrets.secret_digests(sample)) == brute_secrets([(r.doc_id, r.text) for r in sample.collect()])


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("(abcd|xy)z+") is None or "or" in str(secrets.trigram_query("(abcd|xy)z+"))
    assert secrets.trigram_query("ab|cde") is None
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcAB é-"), 40)) for _ in range(300)] + ["", "ab"]
    for pattern in ("ab[cA]a", "(abc|cab)b?a", "a(b|c)a+b", "abc.*cba", "(?:ab){1,2}c", "[abc]ab", "(ab|b)(ca|a)b"):
        query = secrets.trigram_query(pattern)
        found = set(secrets.TrigramIndex(texts, sorted(secrets.trigrams_of(query))).find(query).tolist())
        assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= found


def test_index_is_exact():
    texts = ["abc", "xxabcx", "ab", "ABC", "é abc", "a" * 1_100_000 + "abc"]
    assert secrets.TrigramIndex(texts, ["abc", "zzz"]).find("abc").tolist() == [0, 1, 3, 4, 5]


def test_chat(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "again"), (1, 3, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "other"),
        (3, 0, "user", "hi"), (4, 0, "assistant", r"back\slash <s> \<m></s> [x]"), (5, 0, None, None), (6, 5, "user", "late"), (6, 5, "assistant", "tie"), (6, 5, "user", "late"), (7, 0, "ro<m>le\n", "\n\n"), (8, 0, "assistant", "z" * 30000),
        (9, 0, "user", "hi"), (9, 1, "assistant", "hello"), (9, 2, "user", "again"), (9, 3, "assistant", "yes"), (-3, 0, "user", "hi"), (-3, 1, "assistant", "hello" + chr(92)),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, path int")
    tree = {r.path: r for r in chat.prefix_tree(chat.paths(frame)).collect()}
    order = sorted(tree.values(), key=lambda r: r.start)
    assert [r.path for r in order] == sorted(tree) and all(a.end == b.start for a, b in zip(order, order[1:])) and order[0].start == 0
    assert len({r.path for r in order if r.depth == 1}) == 6
    for r in order:
        above = [tree[r.path[: k * 24]] for k in range(1, r.depth)]
        assert [a for a in order if a.start <= r.start < a.until] == [*above, r] and r.position == sum(len(a.turn) for a in above)
        assert r.until == max(a.end for a in order if a.path.startswith(r.path))
    held = chat.paths(frame).collect()
    for conv in {r.conv_id for r in held}:  # the whole attention mask, character by character
        mine = sorted((r.depth, r.path) for r in held if r.conv_id == conv)
        own = [range(tree[p].start, tree[p].end) for _, p in mine]
        places = [i for x in own for i in x][:400]
        node_at = {i: r for r in order for i in range(r.start, min(r.end, r.start + 400))}
        for k, i in enumerate(places):
            n = node_at[i]
            assert [j for j in places if j <= i and node_at[j].start <= n.start < node_at[j].until] == places[: k + 1]
            assert n.position + i - n.start == k
    everything = queries.with_control_strings(frame)
    convs = defaultdict(list)
    for r in everything.collect():
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    got = rows(chat.format_conversations(everything), "conv_id")
    assert got.keys() == convs.keys()
    for k, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert got[k]["loss_chars"] == len(loss) and got[k]["loss_sha256"] == sha(loss)
        assert got[k]["formatted_chars"] == sum(10 + len(re.sub(r"([\\<\[])", r"\\\1", r + t)) for _, r, t in turns)
    assert chat.format_conversations(frame.limit(0)).count() == 0
