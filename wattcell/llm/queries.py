"""The registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattcell.llm import (
    chat_repair,
    decontaminate,
    embedding_dedup,
    filter_audit,
    language_id,
    line_dedup,
    minmax_dedup,
    mixing,
    multiset_hash,
    paragraph_dedup,
    tool_chat,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
CHAT_SCHEMAS = {"answer": {"query": ("string", True), "turn": ("integer", True)}}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


@query("op1_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query(
    "op2_url_rules",
    f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, {_LOWER.replace('text', 'raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
m AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS nth
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_rules(spark))


@query("op3_repeated_passages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(4, 2)
    found = language_id.predict(docs, language_id.learn(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


_GRAMS = r"""
SELECT DISTINCT {id} AS id, unnest(CASE WHEN len(ws) >= 5
  THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) {short} END) AS g FROM {rows}
"""
_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"


@query(
    "op5_contained_items",
    f"""
WITH iw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ig AS ({_GRAMS.format(id='item_id', rows='iw', short="WHEN ws[1] <> '' THEN [array_to_string(ws, ' ')]")}),
dg AS ({_GRAMS.format(id='doc_id', rows='dw', short="")}),
n AS (SELECT id, count(*) AS n FROM ig GROUP BY id),
s AS (SELECT dg.id AS doc_id, ig.id AS item_id, count(*) AS n_shared FROM dg JOIN ig ON dg.g = ig.g GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM s JOIN n ON n.id = s.item_id WHERE n_shared * 100 >= n * 80
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn is a call of the tool ``answer`` that uses the answer to the user turn two before;
    each assistant turn is the result of the call one turn before."""
    known = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    name = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    arguments = F.to_json(F.struct(F.col("text").alias("query"), "turn"))
    calls = known.where("role = 'user'").select(
        F.col("conv_id").alias("conv"), name(0).alias("call_id"), F.col("turn").alias("seq"), F.lit("answer").alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(2)).alias("after"),
    )
    results = known.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content")
    )
    return calls, results


@query(
    "op6_tool_messages",
    """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, concat(conv_id, '-', turn) AS call_id, CASE WHEN turn >= 2 THEN concat(conv_id, '-', turn - 2) END AS after
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text, concat(conv_id, '-', turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
up AS (SELECT c.*, p.call_id AS parent FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.call_id = c.after),
lev AS (
  SELECT conv_id, call_id, 0 AS level FROM up WHERE parent IS NULL
  UNION ALL
  SELECT up.conv_id, up.call_id, lev.level + 1 FROM up JOIN lev ON up.conv_id = lev.conv_id AND up.parent = lev.call_id),
calls AS (
  SELECT up.*, lev.level, concat_ws(',', CASE WHEN up.text IS NULL THEN 'missing:query' END,
         CASE WHEN up.after IS NOT NULL AND up.parent IS NULL THEN 'after:missing' END,
         CASE WHEN r.call_id IS NULL THEN 'no_result' END) AS wrong
  FROM up JOIN lev ON lev.conv_id = up.conv_id AND lev.call_id = up.call_id LEFT JOIN r ON r.conv_id = up.conv_id AND r.call_id = up.call_id)
SELECT conv_id AS conv, call_id, turn AS seq, 'call' AS kind, cast(2 * level AS bigint) AS level,
       CASE WHEN wrong = '' THEN 'ok' ELSE wrong END AS status,
       concat('{', CASE WHEN after IS NOT NULL THEN concat('"after":', to_json(after), ',') ELSE '' END,
              '"arguments":{', CASE WHEN text IS NOT NULL THEN concat('"query":', to_json(text), ',') ELSE '' END, '"turn":', turn,
              '},"id":', to_json(call_id), ',"name":"answer","role":"assistant"}') AS json
FROM calls
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, 'result', cast(2 * calls.level + 1 AS bigint), CASE WHEN calls.call_id IS NULL THEN 'no_call' ELSE 'ok' END,
       concat('{', CASE WHEN r.text IS NOT NULL THEN concat('"content":', to_json(r.text), ',') ELSE '' END,
              '"id":', to_json(r.call_id), ',"role":"tool"}')
FROM r LEFT JOIN calls ON calls.conv_id = r.conv_id AND calls.call_id = r.call_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tables(table(spark, sf_dir, "conversations"))
    return tool_chat.tool_messages(calls, results, CHAT_SCHEMAS)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(3, 1)
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_REACH = """
reach AS (
  SELECT {id} AS id, {id} AS other FROM {rows}
  UNION
  SELECT reach.id, link.y FROM reach JOIN link ON link.x = reach.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""


@query(
    "op8_near_vectors",
    f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
{_REACH.format(id='vec_id', rows='embeddings').strip()}
SELECT comp.id AS vec_id, (SELECT count(*) FROM link WHERE link.x = comp.id) AS n_links, component_id, comp.id = component_id AS kept FROM comp
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op9_near_documents",
    rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                      WHEN len(ws) = 1 THEN [ws[1]] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
{_REACH.format(id='doc_id', rows='documents').strip()}
SELECT comp.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, comp.id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.id
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), gram=2)


@query("op10_repeated_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_audit",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
f AS (
  SELECT d.doc_id, part,
         concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails,
         d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM d),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
r AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS has, fails = letter AS sole,
         before <> '' AND regexp_matches(fails, '[' || coalesce(nullif(before, ''), '-') || ']') AS gone
  FROM c, s),
t AS (
  SELECT part, filter_order, step, letter,
         cast(sum(CASE WHEN NOT gone AND NOT has THEN n ELSE 0 END) AS bigint) AS kept,
         cast(sum(CASE WHEN NOT gone AND has THEN n ELSE 0 END) AS bigint) AS removed,
         cast(sum(CASE WHEN gone AND has THEN n ELSE 0 END) AS bigint) AS redundant,
         cast(sum(CASE WHEN sole THEN n ELSE 0 END) AS bigint) AS unique_fails,
         cast(sum(CASE WHEN NOT gone AND has THEN good ELSE 0 END) AS bigint) AS good_lost,
         cast(sum(CASE WHEN NOT gone AND has THEN toxic ELSE 0 END) AS bigint) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, letter) AS bigint) AS shapley
FROM t
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Turns damaged by the hash of ``conv_id:turn``, and how often each of them counts."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    )
    return rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)



def _plus(key: str, price: str, letter: str) -> str:
    """SQL that adds an edit to a key: the cost in six digits, then the edits."""
    return f"format('{{:06d}}', substr({key}, 1, 6)::INT + {price}) || substr({key}, 7) || '{letter}'"


#: Keys of the cheapest way to each state: k0 nothing yet, k1 opening system turn, k2 user, k3 answer.
_REPAIR_STEP = f"""
SELECT conv_id, i, k0, k1, k2, least(k3, {_plus('k2', '5', 'I')}) AS k3 FROM (
  SELECT conv_id, i, k0, k1, least(k2, {_plus('k0', '5', 'I')}, {_plus('k1', '5', 'I')}, {_plus('k3', '5', 'I')}) AS k2, k3 FROM (
    SELECT q.conv_id, q.i, {_plus('k0', '2', 'D')} AS k0,
           least({_plus('k1', '2', 'D')}, CASE WHEN NOT gone AND ini = 's' THEN {_plus('k0', 'extra', 'K')} END) AS k1,
           least({_plus('k2', '2', 'D')},
                 CASE WHEN NOT gone THEN least({_plus('k0', '1 + extra', 'R')}, {_plus('k1', '1 + extra', 'R')}, {_plus('k3', '1 + extra', 'R')}) END,
                 CASE WHEN NOT gone AND ini = 'u' THEN least({_plus('k0', 'extra', 'K')}, {_plus('k1', 'extra', 'K')}, {_plus('k3', 'extra', 'K')}) END) AS k2,
           least({_plus('k3', '2', 'D')}, CASE WHEN NOT gone THEN {_plus('k2', '1 + extra', 'R')} END,
                 CASE WHEN NOT gone AND ini = 'a' THEN {_plus('k2', 'extra', 'K')} END) AS k3
    FROM way JOIN q ON q.conv_id IS NOT DISTINCT FROM way.conv_id AND q.i = way.i + 1))
"""


@query(
    "op13_chat_repair",
    rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, substr(role, 1, 1) AS ini,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
  FROM d),
m AS (
  SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS illegal
  FROM o),
q AS (
  SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND tail NOT IN ('.', '!', '?') AS truncated,
         CASE WHEN tail IN ('.', '!', '?') THEN 0 ELSE 5 END AS extra
  FROM m),
way AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000' AS k0, NULL::VARCHAR AS k1, '000005I' AS k2, '000010II' AS k3 FROM c
  UNION ALL
  {_REPAIR_STEP.strip()}),
e AS (
  SELECT conv_id, substr(k, 1, 6)::BIGINT AS cost, substr(k, 7) AS audit
  FROM (SELECT conv_id, least(k0, k3) AS k FROM way QUALIFY i = max(i) OVER (PARTITION BY conv_id))),
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM e),
p AS (
  SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(substr(audit, 1, j), 'I', '')) AS i,
         length(replace(substr(audit, 1, j), 'D', '')) AS nth FROM l),
k AS (
  SELECT p.conv_id, p.j, p.edit, p.nth, CASE WHEN p.edit <> 'I' THEN q.role END AS role, CASE WHEN p.edit = 'I' THEN '' ELSE q.text END AS text,
         max(CASE WHEN p.nth = 1 AND p.edit = 'K' AND q.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS opens
  FROM p LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.i = p.i WHERE p.edit <> 'D'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS text
  FROM k GROUP BY conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM q GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return chat_repair.repair_conversations(rows, copies=copies)
