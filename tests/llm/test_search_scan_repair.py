"""Ranked search, secret scans and structure repair against plain computations."""

import hashlib
import random
import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import credentials, ranked, repair

sys.setrecursionlimit(20_000)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# ---- ranked search


def plain_rank(docs, items, k):
    terms = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in docs]
    held = [(key, c) for key, c in terms if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(ranked.weight(n, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                scored.append((-score, key is not None, key))
        out += [(item, place + 1, key, -s) for place, (s, _, key) in enumerate(sorted(scored)[:k])]
    return out


def some_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ä", "été", "x-y", "Z_9"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30))) for _ in range(n)]
    return texts + texts[: n // 5] + ["", None, "  .,;", "w1 " * 70_000]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranked_equals_plain_scores_with_ties(spark, k):
    docs = list(enumerate(some_texts(k, 300)))
    items = [(10, "w0 w1 w2 w30"), (11, "W0 w0 w59 été"), (12, None), (13, "unknown"), (10, "w0 w1 w2 w30"), (14, "x y 9 z")]
    rows = spark.createDataFrame([(i, t, "a", 5) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked.rank(rows, asked, k=k).collect()]
    assert sorted(got) == sorted(plain_rank(docs, items, k))


def test_ranked_keys_and_empty_tables(spark):
    docs = [("b", "one two"), (None, "one two"), ("a", "one two"), ("a", "one two"), ("c", "three")]
    rows = spark.createDataFrame(docs, "name string, body string")
    items = spark.createDataFrame([("q", "two")], "q string, t string")
    got = [tuple(r) for r in ranked.rank(rows, items, "name", "body", "q", "t", k=3).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [("q", 1, None), ("q", 2, "a"), ("q", 3, "a")]
    assert ranked.rank(rows.limit(0), items, "name", "body", "q", "t").count() == 0
    assert ranked.rank(rows, items.limit(0), "name", "body", "q", "t").count() == 0


def shard_of(texts):
    terms, dfs, places, tfs, lengths = ranked._shard([ranked.terms_of(t) for t in texts])
    row = {"terms": ranked._squeeze(terms), "dfs": ranked._packed(dfs, np.uint16), "places": ranked._packed(places, np.uint16), "tfs": ranked._packed(tfs, np.uint32), "lengths": ranked._packed(lengths, np.uint32)}
    return row, terms, lengths


def test_best_first_opens_few_nodes_and_all_ties():
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randint(0, 400)}" for _ in range(20)) for _ in range(4000)]
    texts[100] = texts[3900] = "v1 v2 v3 v4 v5"
    row, terms, lengths = shard_of(texts)
    asked = np.sort(ranked.terms_of("v1 v2 v3 v4 v5"))
    shard = ranked.Shard(row, asked, len(texts), int(lengths.sum()))
    opened = []
    inner = shard.opened
    shard.opened = lambda level, nodes, *a: opened.extend((level, n) for n in nodes) or inner(level, nodes, *a)
    local, weights = shard.local[np.arange(5)], np.full(5, 1000)
    docs, scores = shard.search(local, weights, 1, 1)
    assert set(docs) == {100, 3900} and len(set(scores)) == 1
    assert sum(level == 1 for level, _ in opened) < 60
    every, bounds = shard.opened(1, np.arange(256), local, weights)
    assert scores[0] == bounds.max() and set(every[bounds == bounds.max()]) == {100, 3900}


# ---- secret scans

PATTERNS = ["ab+c", "(foo|bar)[0-9]", "a?b?c?", "x{3}y", "x{2,}yz", "[ab]cd", "(?:ab|a)bc$", "q.wert", "(ab|cd)(ef|gh)?ij", "é[a-f]+z", "k(?=lm)lm", "abc|[0-9]+", "(abc)*def", "(?>ab)cd"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(PATTERNS), st.lists(st.text(alphabet="abcdefghijxyz019éqwertkml", max_size=12), max_size=6), st.booleans(), st.data())
def test_trigram_queries_lose_no_match(pattern, texts, any_case, data):
    texts = texts + [data.draw(st.from_regex(re.compile(pattern, re.ASCII)))]
    rule = credentials.Rule("k", pattern, any_case=any_case)
    own = credentials.Segment.of([t.encode("utf-8", "replace") for t in texts]).candidates(credentials.trigram_query(pattern, rule.flags))
    assert {i for i, t in enumerate(texts) if re.search(pattern, t, rule.flags)} <= set(own.tolist())


def test_trigram_queries_and_postings():
    assert credentials.trigram_query("[0-9a-f]+") is True
    assert credentials.trigram_query("AKIA[A-Z]+") == ("and", frozenset([b"aki", b"kia"]))
    assert credentials.trigram_query("(foo|bar)x") == ("or", frozenset([("and", frozenset([b"foo", b"oox"])), ("and", frozenset([b"bar", b"arx"]))]))
    assert credentials.full_scans() == ["hex"]
    segment = credentials.Segment.of([b"Foo", b"", b"xfoo foo", b"fo o", b"\xff\xff\xff"])
    assert segment.having(b"foo").tolist() == [0, 2] and segment.having(b"\xff\xff\xff").tolist() == [4]


def plain_spans(text):
    found = []
    for place, r in enumerate(credentials.RULES):
        found += [(m.start(), place, f"{r.kind}:{m.start()}:{m.end()}") for m in re.finditer(r.pattern, text, r.flags) if len(m[r.group]) >= r.least]
    return ",".join(s for _, _, s in sorted(found))


def secret_texts():
    rng = random.Random(5)
    bits = ["password=", "Token: ", "API_KEY == ", "abc", " ", "\n", "é", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0" * 23, '"', "hunter2x", "ghp_" + "a" * 36, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "eyJab.eyJcd." + "x" * 40, "https://u:p@h", "ſecret=abcdefg", "."]
    return ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(700)] + ["", None, "long " * 900_000 + "password=hunter2222", "token=short"]


def test_scan_equals_plain_search_and_the_kept_index(spark):
    texts = secret_texts()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    rows = rows.withColumnRenamed("spans", "kind")
    got = {r.doc_id: r for r in credentials.report(credentials.scan(rows)).collect()}
    assert {i: r.spans for i, r in got.items()} == {i: plain_spans(t or "") for i, t in enumerate(texts)}
    for i, r in got.items():
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")), texts[i]
    index = credentials.segments(rows)
    kept = {(r.key, r.kind) for r in credentials.candidates(index).collect()}
    for i, t in enumerate(texts):
        for s in filter(None, plain_spans(t or "").split(",")):
            assert s.startswith("hex") or (i, s.split(":")[0]) in kept
    assert len(kept) < 8 * len(texts) / 2
    assert credentials.scan(rows.limit(0)).count() == 0


# ---- structure repair

KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """(cost, audit) of the rows (initial, has to go, truncated), from all edits in any order."""

    @lru_cache(None)
    def best(i, s, inserted):
        out = [(0, "")] if i == len(rows) and s in (0, 3) else []
        if inserted < 3:
            c, a = best(i, NEXT[s], inserted + 1)
            out.append((c + 3, "I" + a))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, a = best(i + 1, s, 0)
            out.append((c + 4, "D" + a))
            if not gone:
                if s in KEEP.get(initial, {}):
                    c, a = best(i + 1, KEEP[initial][s], 0)
                    out.append((c + 3 * cut, "K" + a))
                c, a = best(i + 1, NEXT[s], 0)
                out.append((c + 3 + 3 * cut, "R" + a))
        return min(out, default=(10**9, ""))

    return best(0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=11), max_size=8))
def test_tensor_dp_equals_all_edits(conversations):
    codes = [np.array(["suax".index(i) | 4 * gone | 8 * (cut and not gone) for i, gone, cut in rows], np.uint8) for rows in conversations]
    wanted = [cheapest(tuple((i, gone, cut and not gone) for i, gone, cut in rows)) for rows in conversations]
    assert repair.solve(codes) == wanted
    assert [repair.solve_long(c, 2) for c in codes] == wanted


def plain_repair(rows):
    """The whole summary of one conversation from its (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, told, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        gone, cut = not bare or (role, text) in seen, False
        blank, duplicate = blank + (not bare), duplicate + bool(bare and gone)
        if not gone and bare[-1] not in ".!?":
            cut, truncated = True, truncated + 1
        seen.add((role, text))
        told.append((role[:1], gone, cut))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
    cost, audit = cheapest(tuple(told))
    lines, state, at = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(("user", "assistant")[state - 2] + ":")
            continue
        role, text = rows[at][1:]
        at += 1
        if letter in "KR":
            state = KEEP[role[0]][state] if letter == "K" else NEXT[state]
            lines.append((role if letter == "K" else ("user", "assistant")[state - 2]) + ":" + text)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def conversations():
    rng = random.Random(11)
    texts = ["Hi.", "What?", "no end", "", "  ", None, "Well!", "a\nb.", "é. \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]) if c % 3 else i, rng.choice(roles), rng.choice(texts)) for c in range(60) for i in range(rng.randint(1, 9))]
    rows += [(None, i, "user" if i % 2 else "assistant", "x.") for i in range(4)]
    rows += [(-1, i, rng.choice(["user", "assistant"]), rng.choice(texts) or f"t{i}.") for i in range(300)]
    return rows


def test_repair_equals_plain_repair(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn int, role string, text string, kind string").repartition(4)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {777}], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(frame, ids).collect()}
    wanted = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got.pop(777) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: w[0] for c, w in wanted.items()}
    lines = {}
    for r in repair.repaired(frame).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(r.role + ":" + r.text)
    assert lines == {c: w[1] for c, w in wanted.items() if w[1]}
    assert repair.repair(frame.limit(0)).count() == 0


def test_a_long_conversation_streams_in_pieces(spark):
    n = 3 * repair.LONG
    rng = random.Random(2)
    rows = [(i, rng.choice(["user", "assistant"]), f"text {rng.randint(0, n)}" + rng.choice([".", ""])) for i in range(n)]
    frame = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "user", "Hi.")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in repair.repair(frame).collect()}
    codes, seen = [], set()
    for _, role, text in rows:
        gone = (role, text) in seen
        seen.add((role, text))
        codes.append("sua".index(role[0]) | (4 if gone else 0 if text[-1] == "." else 8))
    assert (got[1].cost, got[1].audit) == repair.solve([np.array(codes, np.uint8)])[0]
    assert got[1].duplicate == n - len(seen) and got[2].audit == "KI"
    lines = [r.role + ":" + r.text for r in repair.repaired(frame).where("conv_id = 1").orderBy("place").collect()]
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
