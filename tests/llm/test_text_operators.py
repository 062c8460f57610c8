"""Quality, packing, chat, decontamination, URL, license and language operators against brute force."""

import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import chat, decontam, langid, license, packing, quality, queries, urlfilter
from larkspur.llm.common import encode, fold, shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    as_text = lambda v: repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).map(as_text).to_numpy().tolist()))


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(queries.ORACLE[name]).df())


# ---- word hashes


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbBé \t\n\x0b\x85 xyz", max_size=40), st.text(alphabet="aAbBé \t\n", max_size=40))
def test_word_hashes_agree_with_words(a, b):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    seen = dict(zip(words(a) + words(b), [*word_hashes(encode(a)), *word_hashes(encode(b))], strict=True))
    assert len(set(seen.values())) == len(seen)
    assert list(word_hashes(encode(a))) == [seen[w] for w in words(a)]


def test_long_texts_hash_as_short_ones(monkeypatch):
    import larkspur.llm.common as common

    text = "one two three four five six " * 50
    whole = word_hashes(encode(text))
    monkeypatch.setattr(common, "PIECE", 17)
    assert (word_hashes(encode(text)) == whole).all()


# ---- quality


@needs_tables
def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op1_quality_pu(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all() and got["score"].between(0, 1).all()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, fold("doc_id", 5) != 9).collect()
    assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0
    assert all(r["quality_score"] == 0.5 for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect())


def test_prior_is_found_from_tails():
    rng = np.random.default_rng(0)
    bins = lambda x: np.bincount(np.clip((x * 1000).astype(int), 0, 999), minlength=1000)
    p = rng.beta(8, 2, 20000)
    u = np.concatenate([rng.beta(8, 2, 14000), rng.beta(2, 8, 6000)])
    assert abs(quality.estimate_prior(bins(p), bins(u)) - 0.7) < 0.05


def test_line_length_reads_all_lines():
    short, long = ["junk"] * 1000, ["x" * 400] * 1000
    line_length = lambda lines: quality.features("\n".join(lines))[-1]
    assert line_length(short) == pytest.approx(4 / 500)
    assert line_length(short + long) == line_length(long + short) == pytest.approx(202 / 500)


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


def test_encoder_gives_the_tokenizer_s_ids(tokenizer):
    from tokenizers import Tokenizer

    enc, tok = packing.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    assert enc.fast is not None
    rng = random.Random(1)
    alphabet = "aAzZ019 .,'!\t\n\r\u00a0é한字🙂́\u200d\u2028\x00\x85-_sdtm"
    for text in ["", "it's 12345 we'll  go\n\n x", "<|endoftext|> a", *("".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300))]:
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("space", [" ", "\n", " \n\t\u3000"])
def test_white_space_of_any_length(tokenizer, space):
    from tokenizers import Tokenizer

    encoder, plain_one = packing.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, 1_000_000):
        text = "a b" + (space * n)[:n] + "end "
        assert encoder.encode(text) == plain_one.encode(text, add_special_tokens=False).ids


def test_a_megabyte_of_white_space_is_packed(spark, tokenizer):
    from tokenizers import Tokenizer

    text = "start" + " " * 1_000_000 + "end" + "\n" * 1_000_000
    got = packing.pack_documents(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), tokenizer).collect()
    parts = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got if r["doc_id"] == 1)
    ids = np.frombuffer(b"".join(p[3] for p in parts), "<u4").tolist()
    assert ids == [*Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids, packing.END_ID] and [p[0] for p in parts] == list(range(len(parts)))


def test_packed_pieces_are_whole_and_gapless(spark, tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    rng = random.Random(2)
    texts = [None, "", "a", *(" ".join(rng.choice(["alpha", "be", "gamma,", "§"]) for _ in range(rng.choice([3, 40, 300, 3000]))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, "a"])], "doc_id long, text string, length long")
    rows = packing.pack_documents(docs, tokenizer).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate([*texts, "a"]):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes() and all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
        assert all(r["length"] == 1024 for r in own[1:]) and (len(own) == 1) == (len(ids) <= 1024)
    for own in by_sequence.values():
        ends = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == ends
            ends += r["length"]
        assert ends <= 1024
    bins = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [i for i, b in enumerate(bins) if b + n <= 1024]
        if fits:
            bins[max(fits, key=bins.__getitem__)] += n
        else:
            bins.append(n)
    assert len(by_sequence) <= len(bins)
    assert packing.pack_documents(docs.limit(0), tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=25))
def test_local_search_keeps_documents_and_never_adds_bins(histogram):
    start = packing.best_fit(histogram, 50)
    end = packing.local_search(start, 50)
    for patterns in (start, end):
        found = {}
        for p, n in patterns.items():
            assert sum(p) <= 50
            for x in p:
                found[x] = found.get(x, 0) + n
        assert found == histogram
    assert sum(end.values()) <= sum(start.values())


def test_local_search_empties_bins():
    assert sum(packing.local_search({(6, 2): 1, (5, 3): 1, (4,): 1}, 10).values()) == 2


def test_local_search_ends_without_a_trade_left():
    # 100 bins that nothing fits come first, then two that make one
    stuck = {(401 + i,): 1 for i in range(100)}
    assert sum(packing.local_search(stuck | {(510, 10): 1, (490, 5): 1}, 1000).values()) < 102
    rng = np.random.default_rng(6)
    start = packing.best_fit({int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(250, 900), 400, replace=False)}, 1024)
    end = packing.local_search(start, 1024)
    under = [p for p in end if sum(p) < 1024]
    assert len(under) > 64
    for a in under:
        for b in under:
            if sum(a) <= sum(b) and (a != b or end[a] > 1):
                assert packing._trade(a, b, 1024) is None


# ---- chat


def test_chat_reads_back(spark):
    odd = ["", "\\", "\\b\\e", "</turn>\n### user:\nx", "<and/>\n", "####</turn", "</turn></turn>", "é🙂\n", None]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "a:\nb", "###", None]), rng.choice(odd)) for c in (1, 2, 3, None) for t in [*range(40), 39, 70, 200]]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, None):
        want = sorted(((t, r or "", x or "") for cc, t, r, x in rows if cc == c), key=lambda v: (v[0], v[1].replace("\\", "\\b").replace(":", "\\c").replace("\n", "\\n"), chat_code(v[2])))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [w[1:] for w in want]
        assert got[c]["loss_text"] == "".join(x for _, r, x in want if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def chat_code(text):
    for plain_, code in (("\\", "\\b"), ("</turn>", "\\e"), ("<and/>", "\\a"), ("###", "\\h")):
        text = text.replace(plain_, code)
    return text.encode()


def test_chat_merges_across_segments_and_ids_are_native(spark):
    rows = spark.createDataFrame([(1, t, "user", str(t)) for t in (0, 63, 64, 65)] + [(1, 66, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows)
    assert out.first()["formatted"] == "### user:\n0<and/>\n63<and/>\n64<and/>\n65</turn>\n### assistant:\nok</turn>\n"
    assert [tuple(s) for s in out.first()["loss_spans"]] == [(61, 2)]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# ---- decontamination


def test_spans_of_a_long_conversation(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé漢🙂\\# ") for _ in range(rng.randrange(6))) for _ in range(6000)]
    rows = spark.createDataFrame([(1, t, rng.choice(["user", "assistant"]), x) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows)
    got = out.first()
    roles = [r["role"] for r in rows.orderBy("turn").collect()]
    said = [x for x, r in zip(texts, roles, strict=True) if r == "assistant"]
    code = lambda t: t.replace("\\", "\\b").replace("###", "\\h")
    raw = got["formatted"].encode()
    assert [got["formatted"][s["start"] : s["start"] + s["chars"]] for s in got["loss_spans"]] == [code(x) for x in said]
    assert [raw[s["start"] : s["start"] + s["bytes"]].decode() for s in got["loss_bytes"]] == [code(x) for x in said]
    back = chat.read_back(out).first()
    assert back["loss_text"] == "".join(said) and [(t["role"], t["text"]) for t in back["turns"]] == list(zip(roles, texts, strict=True))


def brute_containment(docs, items, threshold=0.75):
    out = set()
    for item, text in items:
        w = (text or "").encode().lower().split()
        size = min(5, len(w))
        own = decontam.shingles_of(w, size) if w else set()
        for doc, body in docs:
            d = (body or "").encode().lower().split()
            if own and len(d) >= size and len(own & decontam.shingles_of(d, size)) >= threshold * len(own):
                out.add((doc, item))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 17, 40, 80, 130])] + [(90, None), (91, " \n"), (92, "w1 w2 W3")]
    docs = []
    for k in range(80):
        words = make(rng.choice([0, 3, 30, 400]))
        item = rng.choice(items)[1]
        part = (item or "").split()
        cut_to = part[: max(1, int(len(part) * rng.choice([1, 0.9, 0.8, 0.7])))]
        at = rng.randint(0, len(words))
        docs.append((k, " ".join(words[:at] + cut_to + words[at:])))
    docs += [(900, None), (901, "")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]) for r in decontam.contaminated(d, i).select(*decontam.contaminated(d, i).columns).collect()}
    want = brute_containment(docs, items)
    assert got == want and len(want) > 20
    assert decontam.contaminated(d, i.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), i).count() == 0
    kept = {r["doc_id"] for r in decontam.without_items(d, i).collect()}
    assert kept == {k for k, _ in docs} - {a for a, _ in want}


def test_a_short_item_does_not_widen_the_lookups_of_long_ones():
    rng = random.Random(3)
    long = (1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)))
    short = (2, "one two three four five six")
    alone, both = decontam.Index([long]), decontam.Index([long, short])
    assert len(alone.widths[5]) == 1 and len(both.widths[5]) == 2
    assert alone.widths[5][0][0] == both.widths[5][1][0] < both.widths[5][0][0]
    assert [len(hashes) for _, hashes, _ in both.widths[5]] == [2, len(alone.widths[5][0][1])]
    text = "x " + short[1] + " " + " ".join(long[1].split()[:2600]) + " end"
    assert both.search(text) == [(0, pytest.approx(2596 / 2996)), (1, 1.0)]


def test_repeated_documents_are_found_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c d e f"), (7, "b c d e f")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["containment"]) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, 7, 1.0)] * 2 + [(1, 7, 1.0)] * 4


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 20)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(12))) for i in range(7)]
    d = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    got = {(r[0], r[1]) for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(7)}


# ---- URLs


def test_collisions_do_not_decide(tmp_path):
    one = lambda raw: 7
    urlfilter.DigestArray.write(str(tmp_path / "a"), ["x", "y", "z"], one)
    array = urlfilter.DigestArray(str(tmp_path / "a"))
    assert [array.stored(p) if p >= 0 else None for p in array.find(["y", "q", "z", "x"], one)] == [b"y", None, b"z", b"x"]


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://a.example.net/x", "http://example.net", "https://EXAMPLE.com/de/1?q", "http://x.org/fr/", "http://notnet/x", "http://net/", "nothing", None, "http://bad.com/p", "http://a.b.bad.com#x", "http://h?x/en/", "://", "http://a.example.net/en/x"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, queries.RULES, [("bad.com", "")]).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("a.example.net", "/x", "net/", "block"),
        ("example.net", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("notnet", "/x", None, "allow"),
        ("net", "/", "net/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("bad.com", "/p", None, "block"),
        ("a.b.bad.com", "", None, "block"),
        ("h", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
    ]
    assert urlfilter.filter_urls(df, [], []).where("verdict = 'allow'").count() == len(urls)


# ---- licenses


def test_a_block_list_from_a_table_in_several_arrays(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BLOCK", 1000)
    listed = spark.range(5000).selectExpr("concat('h', id, '.test') as host", "if(id % 2 = 0, '', '/bad/') as path").unionAll(spark.sql("select null, '/x'")).unionAll(spark.sql("select 'bare.test', null"))
    rows = [(i, f"http://sub.h{i}.test/bad/page") for i in range(0, 6000, 7)] + [(9001, "http://h1.test/good"), (9002, "https://BARE.test?x"), (9003, None), (9004, "http://h2.test")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["listed"]) for r in urlfilter.filter_urls(pages, [("h14.test", "/", "allow")], listed).collect()}
    for i, _ in rows[:-4]:
        want = ("allow", None) if i == 14 or i >= 5000 else ("block", f"h{i}.test" + ("" if i % 2 == 0 else "/bad/"))
        assert got[i] == want, i
    assert got[9001] == ("allow", None) and got[9002] == ("block", "bare.test") and got[9003] == ("allow", None) and got[9004] == ("block", "h2.test")


def test_urls_of_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(none, queries.RULES, queries.BLOCKLIST).count() == 0 and license.report(none.withColumnsRenamed({"page_id": "doc_id", "url": "text"})).count() == 0


def brute_base(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(p for p, _ in places), sorted({label for _, label in places})


@needs_tables
def test_license_base_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    odd = [(-1, None), (-2, ""), (-3, "Under the MIT-License, under.the/mit license CC by nc cc BY NC"), (-4, "underthe mit license é cc by ncé"), (-5, "x " * 50000 + "apache license version 2")]
    rows = [(r["doc_id"], r["text"]) for r in rows] + odd
    got = {r["doc_id"]: r for r in license.report(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_words string")).collect()}
    for key, text in rows:
        n, places, labels = brute_base(text)
        r = got[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels)), key
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_fuzzy_notices(spark):
    texts = ["Intro. Relased under teh MIT License today", "Licensed under the GNU Genral Public Licence, version 3.", "nothing of the kind here", "released under the bsd license", "licensed under CC BY-SA 4.0"]
    got = license.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "gpl-3", "", "", ""]
    assert [(s["first_word"], s["end_word"], s["edits"] > 0) for s in got[0]["spans"]] == [(1, 6, True)]


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_pigeonhole_loses_nothing(data):
    words, label, _ = data.draw(st.sampled_from(license.NOTICES))
    letters = list(words)
    for _ in range(data.draw(st.integers(0, len(words) // license.CHARS_AN_EDIT))):
        at = data.draw(st.integers(1, len(letters) - 2))
        kind = data.draw(st.sampled_from("sdi"))
        letters[at : at + (kind != "i")] = ["q"] if kind != "d" else []
    joined = b" before " + "".join(letters).encode() + b" after "
    found = license.fuzzy(joined, tuple((w, x, "") for w, x, _ in license.NOTICES))
    pattern = regex.compile(b"(?:%s){e<=%d}" % (words.encode(), len(words) // license.CHARS_AN_EDIT))
    assert bool(pattern.search(joined)) <= (label in {f[0] for f in found})


# ---- language


@needs_tables
def test_language_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98 and (~got["rejected"]).mean() > 0.99


def test_language_odd_rows(spark):
    rng = random.Random(5)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    a, b = ["the", "thing", "with", "other"], ["der", "schön", "über", "nicht"]
    docs = [(i, say(a, 30), "en") for i in range(60)] + [(100 + i, say(b, 30), "de") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df)
    odd = [(1, None), (2, ""), (3, "12 !? 34"), (4, say(a, 20000)), (5, "Über NICHT"), (6, "これは日本語の文章です。" * 20), (6, "これは日本語の文章です。" * 20)]
    got = langid.identify(spark.createDataFrame([(*r, 1.5) for r in odd], "doc_id long, text string, lang_score_in double"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:5] == ["und", "und", "und", "en", "de"]
    assert [r["lang_rejected"] for r in got] == [True, True, True, False, False, True, True]
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_every_language_and_all_training_rows_count(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(" ".join(rng.choice(w) for _ in range(30)), lang) for lang, w in words.items() for _ in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(words)
    assert model.predict([t for t, _ in rows])[0] == [lang for _, lang in rows]
    many = [(" ".join(rng.choice(words["l00"]) for _ in range(30)), "l00") for _ in range(langid.PER_LANGUAGE + 500)]
    model = langid.fit(spark.createDataFrame(many, "text string, lang string"))
    counts = [langid.ngram_counts(t) for t, _ in many]
    df = (np.array(counts) > 0).sum(0)
    assert np.allclose(model.idf, np.log((1 + len(many)) / (1 + df)) + 1, rtol=1e-5)
    best, sizes = model.cosines(counts).max(1), np.array([langid.size_of(c) for c in counts])
    for size in set(sizes):
        # a size of few rows is judged with the shorter ones
        rows = next(r for low in range(size, -1, -1) if low == 0 or langid.LOW * len(r := np.sort(best[(sizes >= low) & (sizes <= size)])) >= 1)
        quantile = rows[int(langid.LOW * len(rows))]
        assert model.least[size] == pytest.approx(langid.MARGIN * quantile, abs=1.1 / langid.BINS)


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.1")), reason="no test tables")
def test_a_language_that_was_not_learned_is_rejected(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, (F.col("lang") != "fr") & (F.col("doc_id") % 5 != 0))
    got = langid.identify(docs.where("doc_id % 5 = 0 or lang = 'fr'"), model).where("length(text) >= 1000").groupBy("lang").agg(F.avg(F.col("lang_rejected").cast("int")).alias("share")).collect()
    shares = {r["lang"]: r["share"] for r in got}
    assert shares.pop("fr") > 0.98
    assert len(shares) == 3 and max(shares.values()) < 0.005


def test_ngrams_in_pieces(monkeypatch):
    text = "the quick brown fox " * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 33)
    assert (langid.ngram_counts(text) == whole).all()


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == len(shingle_set(None)) == 0
    assert json.dumps(sorted(map(int, shingle_set("A b c d e")))) == json.dumps(sorted(map(int, shingle_set("a B c d E"))))


def test_languages_take_letters_alone():
    assert langid.ngram_counts("\u00b2 \u00bd 12 \u201c\u201d \u3002") is None and langid.ngram_counts("") is None
    same = langid.ngram_counts("\u201cdas h\u00e4us\u201d\u3002")
    assert (same == langid.ngram_counts("das h\u00e4us")).all()


def test_predictions_equal_a_plain_computation(spark):
    rng = random.Random(9)
    words = {"xx": "ala bela cora dina elu", "yy": "zug bahn stra\u00dfe mit ohne", "zz": "le la les un une"}
    rows = [(lang, " ".join(rng.choice(w.split()) for _ in range(rng.randrange(3, 40)))) for lang, w in words.items() for _ in range(40)]
    # two languages with the same texts: the first one by name wins
    rows += [("yz", t) for lang, t in rows if lang == "yy"]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(df)
    texts = [t for _, t in rows[::7]] + ["bela", "quatsch", None, "!?"]
    langs, scores, rejected = model.predict(texts)

    def plain(text):
        counts = langid.ngram_counts(text)
        if counts is None:
            return "und", 0.0, True
        x = [math.log1p(float(c)) * float(i) for c, i in zip(counts, model.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        cosines = [sum(a * float(b) for a, b in zip(x, c, strict=True)) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
        return model.languages[model.owner[best]], cosines[best], sum(counts) >= langid.ENOUGH and cosines[best] < model.least[langid.size_of(counts)]

    for text, *got in zip(texts, langs, scores, rejected, strict=True):
        lang, score, gone = plain(text)
        assert got[0] == lang or abs(got[1] - score) < 1e-5, text
        assert got[1] == pytest.approx(min(1, max(0, score)), abs=1e-4) and got[2] == gone
    assert "yz" not in [x for x, t in zip(langs, texts, strict=True) if t and "bahn" in t.split()]


def test_many_places_of_a_phrase(spark):
    text = "x under the MIT license, " * 20_000
    got = license.report(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(got) == 2 and all((r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (20_000, 1, 5 * 20_000 - 4, 100_000) for r in got)


def test_another_alignment_is_tried_where_core_words_fail():
    # the first match in reach lacks the core word, the second holds it
    text = license.normalised("licensed under the apache license version 3 0 licensed under the apache license version 2 0")[0]
    assert [x[0] for x in license.fuzzy(text, tuple(map(tuple, license.NOTICES)))] == ["apache-2"]


def test_quality_scores_equal_a_plain_computation(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "!!", "GAMMA\n", "12"][: 3 + i % 3]) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, "long " * 300_000), (300, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    held = fold("doc_id", 5) == 0
    model = quality.fit(quality.featurise(docs).drop("text"), labels, "doc_id", ~held)
    net = model.network
    got = sorted((r["doc_id"], r["text"] is None, r["quality_score"]) for r in quality.score(quality.featurise(docs), model).collect())
    for (i, none, score), (_, text) in zip(got, sorted([*rows, (300, "long " * 300_000), (300, None)], key=lambda r: (r[0], r[1] is None)), strict=True):
        x = quality.features(text).astype(float)
        z = net.c
        for j in range(quality.HIDDEN):
            z += math.tanh(sum(min(8.0, max(-8.0, (a - m) / s)) * w for a, m, s, w in zip(x, net.mean, net.scale, net.w[:, j], strict=True)) + net.b[j]) * net.v[j]
        assert none == (text is None) and score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), i
