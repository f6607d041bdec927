"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscora.llm.common import UPPER, read


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op1_token_planes import op1_token_planes as op

    return op(spark, read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op2_decontaminate import op2_decontaminate as op

    return op(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op3_main_text import op3_main_text as op

    return op(read(spark, sf_dir, "pages"))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op4_jpeg_media import op4_jpeg_media as op

    return op(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op5_near_dedup import op5_near_dedup as op

    return op(read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op6_secrets import op6_secrets as op

    return op(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op8_toxicity import op8_toxicity as op

    return op(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op10_mixture import op10_mixture as op

    return op(read(spark, sf_dir, "documents"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op9_line_runs import op9_line_runs as op

    return op(read(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op7_surrogates import op7_surrogates as op

    return op(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op11_fill_in_middle import op11_fill_in_middle as op

    return op(read(spark, sf_dir, "documents"))


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op12_permutation_index import op12_permutation_index as op

    return op(read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscora.llm.op13_merkle_manifest import op13_merkle_manifest as op

    return op(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS s FROM d, lens)),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Sets, their classes, links of classes by shared shingles, and what can be reached over them.
OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(1))) END AS k, s FROM s),
c AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE k IS NOT NULL GROUP BY k),
u AS (SELECT rep, n, unnest(s) AS g FROM c),
l AS (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, cast(k.n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM k LEFT JOIN c USING (k) LEFT JOIN m ON m.x = c.rep
"""

OP11_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
n AS (SELECT doc_id, t, u, cast(len(u) AS BIGINT) AS n, cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2, cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("cast(doc_id AS VARCHAR)", "source", "lang", f"cast({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


#: DuckDB has no crc32; the rows that are tampered with are told by it in eight steps for each byte.
_CRC32 = (
    "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(k)), lambda j: ascii(k[j + 1])::UBIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda j: 0::UBIGINT)), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
)

OP13_SQL = f"""
WITH RECURSIVE k AS (SELECT *, cast(doc_id AS VARCHAR) AS k FROM documents),
rows_ AS (SELECT coalesce('=' || lang, '') AS g, doc_id, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars::HUGEINT + 1")} AS changed, coalesce(xor({_CRC32}, 4294967295::UBIGINT) % 7 = 0, false) AS bad FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows_),
t AS (SELECT g, 0 AS lv, i, n, leaf AS h FROM l
      UNION ALL
      SELECT g, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lv, i // 2, n),
s AS (SELECT g, h, lv FROM t WHERE n = 1),
s0 AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM s),
u AS (SELECT 0 AS lv, i, n, h FROM s0
      UNION ALL
      SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 2, n),
steps AS (SELECT l.g, l.i, x.lv, x.lv AS pos, (l.i >> x.lv) & 1 AS bit, y.h AS sib FROM l JOIN (SELECT DISTINCT g, lv, n FROM t WHERE n > 1) x ON x.g = l.g
          LEFT JOIN t y ON y.g = l.g AND y.lv = x.lv AND y.i = xor(l.i >> x.lv, 1)
          UNION ALL
          SELECT l.g, l.i, x.lv, s.lv + x.lv, (s0.i >> x.lv) & 1, y.h FROM l JOIN s ON s.g = l.g JOIN s0 ON s0.g = l.g CROSS JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) x
          LEFT JOIN u y ON y.lv = x.lv AND y.i = xor(s0.i >> x.lv, 1)),
paths AS (SELECT g, i, list(struct_pack(b := bit, s := coalesce(sib, '')) ORDER BY pos) AS path, string_agg(coalesce(sib, ''), '' ORDER BY pos) AS sibs FROM steps GROUP BY g, i),
fold AS (SELECT l.g, l.i, 0 AS pos, CASE WHEN bad THEN changed ELSE leaf END AS h, coalesce(path, []) AS path FROM l LEFT JOIN paths USING (g, i)
         UNION ALL
         SELECT g, i, pos + 1, sha256(CASE WHEN path[pos + 1].b = 1 THEN path[pos + 1].s || h ELSE h || path[pos + 1].s END), path FROM fold WHERE pos < len(path))
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(coalesce(sibs, '')) AS proof_sha256, fold.h AS folded_root, fold.h = r.h AS verified
FROM l JOIN s USING (g) CROSS JOIN (SELECT h FROM u WHERE n = 1) r LEFT JOIN paths ON paths.g = l.g AND paths.i = l.i JOIN fold ON fold.g = l.g AND fold.i = l.i AND fold.pos = len(fold.path)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_planes, op2_decontaminate, op3_main_text, op4_jpeg_media, op5_near_dedup, op6_secrets, op7_surrogates, op8_toxicity, op9_line_runs, op10_mixture, op11_fill_in_middle, op12_permutation_index, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op5_near_dedup": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
