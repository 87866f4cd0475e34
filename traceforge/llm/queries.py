"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SQL = {
    "op8_repeats": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
w AS (SELECT rid, doc_id, pos, """ + " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER f" for i in range(1, 20)]]) + r""" AS g FROM u WINDOW f AS (PARTITION BY rid ORDER BY pos)),
k AS (SELECT rid, pos, rank() OVER (PARTITION BY g ORDER BY doc_id, pos) AS nth FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT rid, pos + i AS pos FROM k, range(0, 20) t(i) WHERE nth > 1),
kept AS (SELECT u.rid, string_agg(word, ' ' ORDER BY u.pos) AS t, count(*) AS n FROM u ANTI JOIN gone USING (rid, pos) GROUP BY u.rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE t AS (SELECT list(list_reduce([c] || range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY c) AS t FROM range(256) r(c)),
d AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    coalesce(xor(list_reduce([4294967295] || list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS bad
  FROM documents, t
), l AS (
  SELECT doc_id, lang, idx, n, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN bad AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM d
), nodes AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM l
  UNION ALL SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n
), subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, h FROM subs
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n
), steps AS (
  SELECT l.lang, l.idx AS of_leaf, p.lvl, p.idx % 2 AS side, coalesce(s.h, '') AS sib
  FROM l JOIN nodes p ON p.lang IS NOT DISTINCT FROM l.lang AND p.n > 1 AND p.idx = l.idx >> p.lvl LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = p.lvl AND s.idx = xor(p.idx, 1)
  UNION ALL SELECT l.lang, l.idx, 1000 + p.lvl, p.idx % 2, coalesce(s.h, '')
  FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang JOIN tops p ON p.n > 1 AND p.idx = subs.idx >> p.lvl LEFT JOIN tops s ON s.lvl = p.lvl AND s.idx = xor(p.idx, 1)
), paths AS (SELECT lang, of_leaf, list({side: side, sib: sib} ORDER BY lvl) AS path FROM steps GROUP BY lang, of_leaf)
SELECT l.doc_id, l.leaf, subs.h AS subroot, r.h AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.sib), ''), '')) AS proof_sha256,
  CASE WHEN tampered IS NULL THEN r.h ELSE list_reduce([tampered] || list_transform(coalesce(path, []), lambda x: x.side || x.sib), lambda a, b: sha256(CASE WHEN b[1] = '1' THEN b[2:] || a ELSE a || b[2:] END)) END AS folded_root,
  folded_root = r.h AS verified
FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang JOIN tops r ON r.n = 1 LEFT JOIN paths ON paths.lang IS NOT DISTINCT FROM l.lang AND paths.of_leaf = l.idx
""",
    "op12_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
k AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2, ('0x' || x[17:24])::BIGINT % 100 AS c3, ('0x' || x[25:32])::BIGINT % 100 AS c4 FROM h),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS out FROM f
), q AS (
  SELECT *, CASE form WHEN 'plain' THEN [] WHEN 'psm' THEN [substr(out, 4, instr(out, '<S>') - 4), substr(out, instr(out, '<M>') + 3), substr(out, instr(out, '<S>') + 3, instr(out, '<M>') - instr(out, '<S>') - 3)]
    ELSE [substr(out, instr(out, '<P>') + 3, instr(out, '<M>') - instr(out, '<P>') - 3), substr(out, instr(out, '<M>') + 3), substr(out, 4, instr(out, '<P>') - 4)] END AS parts FROM o
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(out) AS output_sha256, sha256(CASE form WHEN 'plain' THEN out ELSE array_to_string(parts, '') END) AS restored_sha256
FROM q
""",
    "op9_near_copies": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN k ON k.doc_id = d.doc_id
""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .extraction import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their predicted language; held-out ones are not learned from."""
    from .language import fit, identify

    documents = _table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licence notices that stand in them."""
    from .licences import licence_scan

    return licence_scan(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator on instruction data: whole conversations under limits of tokens, segments and loss-bearing tokens."""
    from .packing import Limits, conversation_sizes, pack_examples

    return pack_examples(conversation_sizes(_table(spark, sf_dir, "conversations")), Limits(tokens=2048, segments=8, loss_tokens=1024))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and the compression bands, their lower limits fitted on labelled documents."""
    from .quality import fit, quality_report

    documents = _table(spark, sf_dir, "documents")
    return quality_report(documents, fit(documents, _table(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back."""
    from .tokenfiles import read_digests, write_files

    return read_digests(spark, write_files(_table(spark, sf_dir, "documents")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 20 that start earlier elsewhere."""
    from .repeats import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"), window=20)


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of near copies, on 2-word shingles."""
    from .nearcopies import near_copies

    return near_copies(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose id is divisible by 100, searched for among all images drawn from ``embeddings`` and their edited copies."""
    from .media import find_copies, gallery

    return find_copies(gallery(_table(spark, sf_dir, "embeddings")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a Merkle tree by language, each with its proof, checked after every seventh was tampered with."""
    from .merkle import FIELDS, digest, folded, framed, manifest, proof_digest

    longer = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars").cast("long"))
    tampered = digest(*[framed(longer if c == "n_chars" else F.col(c)) for c in FIELDS])
    found = manifest(_table(spark, sf_dir, "documents"), carry={"tampered": tampered})
    checked = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in the middle, and rebuilt from the output."""
    from .fim import fim_documents

    done = fim_documents(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their number of byte-level BPE tokens."""
    from .tokencounts import token_counts
    from .wordids import tokenizer_path

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_extraction, op2_language, op3_licences, op4_packing, conversation_packing, op5_mixing, op6_quality, op7_token_files, op8_repeats, op9_near_copies, op10_image_copies, op11_merkle_manifest, op12_fill_in_middle, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    from .licences import oracle

    return SQL | {"op3_licences": oracle()}
