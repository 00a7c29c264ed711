"""The registered queries of this subpackage, each over its whole tables, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.jaccard_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.token_store import store_digests

    return store_digests(_read(spark, sf_dir, "documents"))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.ball_tree import top_k

    rows = _read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.token_counts import count_after_edits, sample_edits

    docs = _read(spark, sf_dir, "documents")
    return count_after_edits(docs, sample_edits())


#: Target weights of the mixture, by level; whatever is not named weighs 1, and 0 leaves out.
MIX_WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src1": 3, "src4": 2, "src7": 0}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.chat import format_chats

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return format_chats(turns.unionByName(probe)).drop("branch")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.recompression import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.prefix_trie import prefix_trie, rebuild

    return prefix_trie(rebuild(_read(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.llm.collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_packing, op3_ngram_jaccard_join, op4_token_store, op5_top_k_search, op6_token_counts, op7_mixing, op8_html_extraction, op9_chat_formatting, op10_exact_dedup, op11_substring_dedup, op12_prefix_trie, op13_collocations, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def _escaped(col: str) -> str:
    from binfold.llm.chat import CONTROL

    out = f"replace(coalesce({col}, ''), '\\', '\\0')"
    for k, mark in enumerate(CONTROL, 1):
        out = f"replace({out}, '{mark}', '\\{k}')"
    return out


def _weight_sql(level: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
    return f"CAST(CASE {level} {whens} ELSE 1 END AS DOUBLE)"


def _share_sql(name: str, source: str, parent: str, key: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    keys = f"{parent}, {key}" if parent else key
    return f"""
{name}_a AS (SELECT *, {_weight_sql(key)} AS w, cap / {_weight_sql(key)} AS ratio FROM {source} WHERE cap > 0),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({order}), 0) AS cap_before, sum(w) OVER ({part}) - coalesce(sum(w) OVER ({order}), 0) AS w_left FROM {name}_a),
{name}_c AS (SELECT *, cap * w_left <= w * (parent_budget - cap_before) AS is_full FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS cap_full, sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER ({part}) AS w_open FROM {name}_c),
{name} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE least(cap, floor(greatest(parent_budget - cap_full, 0) * w / nullif(w_open, 0))) END AS BIGINT) AS budget FROM {name}_d)"""


ORACLES: dict[str, str] = {
    "op5_top_k_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_mixing": f"""
WITH rows AS (SELECT doc_id, 'd' || CAST(ascii(md5(source)) % 4 AS VARCHAR) AS dom, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, {_WORDS} AS n_tokens FROM documents),
r AS (SELECT doc_id, coalesce(dom, 'unknown') AS domain, lang, source, n_tokens FROM rows),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(CASE WHEN {_weight_sql('domain')} * {_weight_sql('lang')} * {_weight_sql('source')} > 0 THEN sum(n_tokens) * 2 ELSE 0 END AS BIGINT) AS cap FROM r GROUP BY domain, lang, source),
l1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaves) AS parent_budget FROM leaves GROUP BY domain),
{_share_sql('b1', 'l1', '', 'domain')},
l2 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, any_value(b1.budget) AS parent_budget FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
{_share_sql('b2', 'l2', 'domain', 'lang')},
l3 AS (SELECT domain, lang, source, cap, b2.budget AS parent_budget FROM leaves JOIN b2 USING (domain, lang)),
{_share_sql('b3', 'l3', 'domain, lang', 'source')},
b AS (SELECT leaves.domain, leaves.lang, leaves.source, tokens, coalesce(budget, 0) AS leaf_budget, CASE WHEN tokens > 0 THEN coalesce(budget, 0) // tokens ELSE 0 END AS epochs FROM leaves LEFT JOIN b3 USING (domain, lang, source)),
k AS (SELECT r.*, leaf_budget, epochs, leaf_budget - epochs * tokens AS rest, md5('mix:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM r JOIN b USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c""",
    "op9_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, '<|im_start|>' || replace({_escaped('role')}, chr(10), '\\n') || chr(10) || {_escaped('text')} || '<|im_end|>' || chr(10) AS s FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(s)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, text_sha256 FROM g""",
    "op11_substring_dedup": """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents),
g AS (SELECT doc_id, pos, word, concat_ws(' ', word, %s) AS win, count(*) OVER (PARTITION BY doc_id) AS n FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, CASE WHEN pos + 19 <= n AND row_number() OVER (PARTITION BY pos + 19 <= n, win ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM g),
k AS (SELECT doc_id, pos, word, max(CASE WHEN pos + 19 <= n THEN again ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
a AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)"""
    % ", ".join(f"lead(word, {k}) OVER d" for k in range(1, 20)),
    "op12_prefix_trie": """
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n_own FROM own GROUP BY c),
bytes AS (SELECT c, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))) AS b FROM cs),
crc AS (SELECT c, xor(list_reduce(b, lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) AS crc FROM bytes),
k AS (SELECT crc.c, crc % 6 AS h, crc.c - crc.c % 100 AS base, least(crc % 6, coalesce(x.n_own, 0)) AS taken FROM crc LEFT JOIN cs AS x ON x.c = crc.c - crc.c % 100),
t AS (SELECT k.c, nth AS d, role, text FROM k JOIN own ON own.c = base AND nth <= taken UNION ALL SELECT k.c, nth - h + taken, role, text FROM k JOIN own ON own.c = k.c AND nth > h),
p AS (SELECT c, d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM t UNION ALL SELECT c, 0, 0, '' FROM k),
m AS (SELECT *, min(c) OVER (PARTITION BY d, prefix) AS node, max(d) OVER (PARTITION BY c) AS len FROM p),
nodes AS (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, string_agg(CASE WHEN d = len THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM m GROUP BY node, d),
up AS (SELECT a.node, a.d, a.saved, b.node AS top, b.d AS top_d FROM nodes AS a JOIN m AS b ON b.c = a.node AND b.d <= a.d),
kids AS (SELECT top, top_d, count(*) AS n_children FROM up WHERE d = top_d + 1 GROUP BY top, top_d),
sums AS (SELECT up.top, up.top_d, sum(saved) AS saved, count(*) FILTER (WHERE kids.top IS NULL) AS n_leaves FROM up LEFT JOIN kids ON kids.top = up.node AND kids.top_d = up.d GROUP BY up.top, up.top_d)
SELECT n.node AS conv_id, n.d AS depth, (SELECT any_value(b.node) FROM m AS b WHERE b.c = n.node AND b.d = n.d - 1) AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes AS n JOIN sums AS s ON s.top = n.node AND s.top_d = n.d LEFT JOIN kids AS q ON q.top = n.node AND q.top_d = n.d""",
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS ({' UNION ALL '.join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM p" for k in (1, 2, 3, 4))}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, s.cut, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS cut) AS s ON s.cut < c.k
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:s.cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[s.cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
subs AS (SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, max(c.a) AS around FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY 1, 2),
ok AS (SELECT best.* FROM best LEFT JOIN subs USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ok)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN n USING (lang) WHERE rank <= 2000""",
}
