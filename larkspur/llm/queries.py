"""The queries opN_<name> and pipeline, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, credentials, decontam, jaccard, langid, license, lm, media, packing, quality, ranked, repair, urlfilter
from larkspur.llm.common import fold, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: hosts of spam pages, with all their subdomains
BLOCKLIST = [(f"{name}.example.{top}", "") for name in ("spam-farm", "cheap-pills") for top in ("com", "net", "org")]
CUTOFF = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), keep=("held_out",))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= CUTOFF).cast("int").alias("predicted"))


def op2_pack_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    back = chat.read_back(chat.format_conversations(rows))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return lm.score(docs, ~F.col("held_out"), keep=("held_out",))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    images = media.rendered(media.dealt(vectors), "vec_id", "embedding")
    asked = media.rendered(vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", edited=True).withColumnRenamed("vec_id", "query_id")
    found, members = media.find_copies(images, asked, key="vec_id")
    return found.join(members.select(F.col("query_id").alias("vec_id"), F.col("class_id").alias("query_class")), "vec_id", "left")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES, BLOCKLIST).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.report(table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 5) == 0).alias("held_out"))
    model = langid.fit(docs, ~F.col("held_out"))
    out = langid.identify(docs.drop("lang"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_quality_pu, op2_pack_swap, op3_chat_format, op4_lm_score, op5_decontaminate, op6_media_copies, op7_url_filter, op8_license_scan, op9_language_id, op10_ngram_jaccard, op11_ranked_search, op12_secret_scan, op13_structure_repair)}

ORACLE: dict[str, str] = {}
ORACLE["op3_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), coded AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '<and/>', '\a'), '###', '\h') AS safe,
    coalesce(lag(role) OVER w = role, false) AS joined,
    coalesce(lead(role) OVER w = role, false) AS goes_on
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN joined THEN 7 ELSE 6 + length(role) END + CASE WHEN goes_on THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
ORACLE["op7_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(action, length(h) * 1000 + length(p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""
ORACLE["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n.n) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(n.n)
"""
ORACLE["op10_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.root)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
ORACLE["op11_ranked_search"] = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, g GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN c USING (t) JOIN w USING (t) JOIN n USING (doc_id), g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def _secrets_sql() -> str:
    """Spans from the pieces between matches; a letter that counts in either case is written as a class."""
    rules = []
    for place, rule in enumerate(credentials.RULES):
        pattern = rule.pattern
        if rule.any_case:
            head, _, tail = pattern.partition(")")
            pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail
        # runs are as long as they can be, so that a short one holds no longer one
        pattern = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}.get(rule.kind, pattern).replace("'", "''")
        rules.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(own) AS own, unnest(g[:len(m)]) AS g
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS own, string_split_regex(text, '{pattern}') AS g FROM d)""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in credentials.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(rules)}),
y AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM x),
z AS (SELECT doc_id, kind, place, e - length(m) AS s, e FROM y WHERE length(own) >= CASE kind {least} END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place), '') AS spans
FROM d LEFT JOIN z USING (doc_id) GROUP BY doc_id
"""


ORACLE["op12_secret_scan"] = _secrets_sql()
ORACLE["op13_structure_repair"] = r"""
WITH RECURSIVE bits AS (
  SELECT range AS k, range AS v, 0 AS r FROM range(256)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, r + 1 FROM bits WHERE r < 8
), crc AS (SELECT list(v ORDER BY k) AS t FROM bits WHERE r = 8),
planted AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS f
  FROM conversations, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM planted WHERE f <> 0
), told AS (
  SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open
  FROM rows
), marked AS (
  SELECT *, blank OR seen AS gone, CASE WHEN open AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS more,
    coalesce(lag(c) OVER w || c NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (more > 0) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS i, {c: 0, a: '', r: ''} AS v0, {c: 6, a: 'II', r: 'user:' || chr(10) || 'assistant:' || chr(10)} AS v1,
    {c: 3, a: 'I', r: 'assistant:' || chr(10)} AS v2, {c: 0, a: '', r: ''} AS v3 FROM facts
  UNION ALL
  SELECT conv_id, i - 1, list_min([w0, u]), list_min([w1, u]), list_min([w2, {c: 3 + w3.c, a: 'I' || w3.a, r: 'assistant:' || chr(10) || w3.r}]), list_min([w3, u])
  FROM (SELECT *, list_min([{c: 3 + w2.c, a: 'I' || w2.a, r: 'user:' || chr(10) || w2.r}, {c: 6 + w3.c, a: 'II' || w3.a, r: 'user:' || chr(10) || 'assistant:' || chr(10) || w3.r}]) AS u FROM (
    SELECT conv_id, i,
      list_min(list_filter([d0, CASE WHEN c = 's' THEN {c: k + v1.c, a: 'K' || v1.a, r: line || v1.r} END, CASE WHEN c = 'u' THEN {c: k + v2.c, a: 'K' || v2.a, r: line || v2.r} END, {c: 3 + k + v2.c, a: 'R' || v2.a, r: u_line || v2.r}], lambda x: x IS NOT NULL AND x.c < 1000000)) AS w0,
      list_min(list_filter([d1, CASE WHEN c = 'u' THEN {c: k + v2.c, a: 'K' || v2.a, r: line || v2.r} END, {c: 3 + k + v2.c, a: 'R' || v2.a, r: u_line || v2.r}], lambda x: x IS NOT NULL AND x.c < 1000000)) AS w1,
      list_min(list_filter([d2, CASE WHEN c = 'a' THEN {c: k + v3.c, a: 'K' || v3.a, r: line || v3.r} END, {c: 3 + k + v3.c, a: 'R' || v3.a, r: a_line || v3.r}], lambda x: x IS NOT NULL AND x.c < 1000000)) AS w2,
      list_min(list_filter([d3, CASE WHEN c = 'u' THEN {c: k + v2.c, a: 'K' || v2.a, r: line || v2.r} END, {c: 3 + k + v2.c, a: 'R' || v2.a, r: u_line || v2.r}], lambda x: x IS NOT NULL AND x.c < 1000000)) AS w3
    FROM (
      SELECT walk.*, m.c, CASE WHEN gone THEN 1000000 ELSE more END AS k, role || ':' || text || chr(10) AS line, 'user:' || text || chr(10) AS u_line, 'assistant:' || text || chr(10) AS a_line,
        {c: 4 + v0.c, a: 'D' || v0.a, r: v0.r} AS d0, {c: 4 + v1.c, a: 'D' || v1.a, r: v1.r} AS d1, {c: 4 + v2.c, a: 'D' || v2.a, r: v2.r} AS d2, {c: 4 + v3.c, a: 'D' || v3.a, r: v3.r} AS d3
      FROM walk JOIN marked m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.i = walk.i)))
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(left(v0.r, -1), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM ids.conv_id AND walk.i = 0
"""
