"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_fold import decode, encode
from .conversation_repair import repair_report
from .decontamination import contamination, digests
from .embedding_dedup import near_duplicate_vectors
from .html_extract import main_text
from .importance import importance_ranks
from .lpf_dedup import remove_later_copies
from .ngram_jaccard import ngram_jaccard_components
from .pii_bootstrap import KINDS, count_of, named, personal_data
from .token_output import token_sequences
from .topk_inner import top_inner
from .toxicity import score_documents
from .vector_packing import pack_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM ws),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM pair JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
  WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(v) FROM reach r WHERE r.u = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@_query("op2_exact_topk_inner", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query("op3_token_matrix_output")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_sequences(table(spark, sf_dir, "documents"))


@_query("op4_lpf_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
seg AS (SELECT doc_id, k, len(h) // 2 - 50 - 256 * k AS last, substr(h, 512 * k + 1, 610) AS h
        FROM d, unnest(range(0, len(h) // 512 + 1)) AS t(k)),
w AS (SELECT doc_id, 256 * k + o AS p, substr(h, 2 * o + 1, 100) AS s FROM seg, unnest(range(0, least(256, last + 1))) AS t(o)),
lo AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
gone AS (SELECT doc_id, p FROM w JOIN lo USING (s) WHERE doc_id > lo),
edge AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM gone),
isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edge),
span AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM isle GROUP BY doc_id, g),
cuts AS (SELECT doc_id, b AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM span
         UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS h
         FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op5_byte_bpe_fold")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op6_collision_counting_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u),
c AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


@_query("op7_html_tree_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@_query("op9_toxicity_nb_ngrams")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op8_vector_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@_query("op10_pii_bootstrap")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_of("base", k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))



# words of letters and digits after A-Z are lower-cased; CRC-32 four bits at a time
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_CRC_TABLE = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(4)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(16) r(i)) x)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h)),
  lambda i: strpos('0123456789ABCDEF', substr(h, (CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::BIGINT, 1)) - 1)),
  lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1])))"""


@_query("op11_bit_sliced_resampling", f"""
WITH {_CRC_TABLE},
w AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, {_WORDS} FROM benchmark),
f AS (SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w),
n AS (SELECT side, rid, s, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT s, {_CRC} % 10000 AS b FROM (SELECT DISTINCT s, hex(encode(s)) AS h FROM n), tab),
k AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n JOIN b USING (s) GROUP BY b),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
g AS (SELECT b, floor(1000 * ln(((k.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE) / ((k.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS g
      FROM k, a),
x AS (SELECT rid, sum(n * g) AS weight, sum(n) AS n FROM n JOIN b USING (s) JOIN g USING (b) WHERE side = 0 GROUP BY rid),
d AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
      FROM w LEFT JOIN x USING (rid) WHERE side = 0),
r AS (SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS pos,
        count(*) OVER (PARTITION BY words >= 20) AS n FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND pos <= 5 * n // 100 THEN pos END AS rank FROM r
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@_query("op13_window_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
         lambda p: array_to_string(w[p:p + 9], ' '))) AS s FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS p,
         unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM d, k),
h AS (SELECT rid, p, dw.k, item FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
c AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _least(*options: str) -> str:
    """The struct of the least (cost, audit); null ones do not count."""
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _step(v: str, cost: str, letter: str, line: str) -> str:
    """An edit before what ``v`` holds: cost, letters and repaired lines are put in front."""
    return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a, 't': list_concat({line}, {v}.t)}} END"


_AFTER = (2, 2, 3, 2)
_GIVEN = ("user", "user", "assistant", "user")
_KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _closed(names: list[str]) -> str:
    """Columns v0..v3 from those with up to two rows inserted first."""
    def ins(s, v):
        return _step(v, "5", "I", f"['{_GIVEN[s]}:']")
    out = []
    for s in range(4):
        one, two = _AFTER[s], _AFTER[_AFTER[s]]
        out.append(f"{_least(names[s], ins(s, names[one]), ins(s, '(' + ins(one, names[two]) + ')'))} AS v{s}")
    return ", ".join(out)


def _row(s: int) -> str:
    """The least edit of a row in state ``s``, from v0..v3 behind it."""
    stays = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    kept = " ".join(f"WHEN k = '{k}' THEN {_step(f'v{to}', f'({stays})', 'K', '[role || chr(58) || text]')}" for k, to in _KEEPS[s].items())
    free = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    given = f"['{_GIVEN[s]}:' || text]"
    return _least(_step(f"v{s}", "2", "D", "[]"), f"CASE WHEN {free} THEN (CASE {kept} END) END",
                  f"CASE WHEN {free} THEN ({_step(f'v{_AFTER[s]}', f'(1 + {stays})', 'R', given)}) END")


@_query("op12_checkpointed_repair", f"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
e AS (SELECT *, {_CRC} % 20 AS e FROM k, tab),
r AS (SELECT conv_id, turn, CASE WHEN e = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN e = 1 THEN '' WHEN e = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN e = 3 THEN [1, 2] ELSE [1] END) AS copy FROM e WHERE e <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r),
f AS (SELECT *, substr(role, 1, 1) AS k, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS done),
p AS (SELECT conv_id, n + 1 AS i, done AS w0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS w1,
        NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS w2, done AS w3 FROM n, z),
g AS (SELECT conv_id, i, {_closed(['w0', 'w1', 'w2', 'w3'])} FROM p
  UNION ALL
  SELECT conv_id, i, {_closed(['w0', 'w1', 'w2', 'w3'])} FROM (
    SELECT g.conv_id, f.i, {', '.join(f'{_row(s)} AS w{s}' for s in range(4))}
    FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1) s),
d AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND g.i = 1
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
