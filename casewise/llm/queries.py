"""The corpus operators as named queries over whole tables and, where SQL can express it, the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm import caps, decontamination, html, infill, jaccard, katz, merkle, mixing, secrets, substrings, tokens, toxicity, vptree
from casewise.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 along the sources, three epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokens.token_digest(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three quarters."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 4) != 2)
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), model)
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "threshold", "flagged",
    )


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontamination.contamination(docs, items)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win USING (phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a similarity of 0.8 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.9 or more among all embeddings."""
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that repeat elsewhere."""
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = fold("doc_id", 5) != 1
    scored = katz.score(docs, katz.train(docs.where(learned)), learned)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a middle moved to its end, by a seeded choice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.fill_in_middle(docs, output=False)


ORACLES["op13_infill"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
f AS (
  SELECT doc_id, n, x, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM f
"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, one in seven of them tampered with."""
    return merkle.manifest_check(table(spark, sf_dir, "documents"))


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(map(_field, fields)) + ")"


#: Bytes of the decimal id folded into a crc32, bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"
)


def _tree(name: str, group: str, source: str) -> str:
    """Levels of a tree: lvl, group, idx, h and m, the number of nodes of the level."""
    return (
        f"{name} AS (SELECT 0 AS lvl, {group}, idx, h, count(*) OVER (PARTITION BY {group}) AS m FROM {source} UNION ALL "
        f"SELECT lvl + 1, {group}, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(m) + 1) // 2 FROM {name} WHERE m > 1 GROUP BY lvl, {group}, idx // 2)"
    )


def _steps(name: str, tree: str, group: str, source: str) -> str:
    """Siblings of each row of ``source`` (group, idx) on its way up: L or R and the hash, or - where there is none."""
    return (
        f"{name} AS (SELECT s.{group}, s.idx, list(CASE WHEN n.h IS NULL THEN '-' WHEN (s.idx >> l.lvl) & 1 = 1 THEN 'L' || n.h ELSE 'R' || n.h END ORDER BY l.lvl) AS steps "
        f"FROM {source} s JOIN (SELECT DISTINCT lvl, {group} FROM {tree} WHERE m > 1) l ON l.{group} IS NOT DISTINCT FROM s.{group} "
        f"LEFT JOIN {tree} n ON n.lvl = l.lvl AND n.{group} IS NOT DISTINCT FROM s.{group} AND n.idx = xor(s.idx >> l.lvl, 1) GROUP BY s.{group}, s.idx)"
    )


ORACLES["op11_merkle"] = "WITH RECURSIVE " + ",\n".join(
    [
        f"d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS h, CASE WHEN coalesce({_CRC}, 0) % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed FROM documents)",
        "leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM d)",
        _tree("lv", "lang", "leaf"),
        "sub AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM lv WHERE m = 1)",
        _tree("tp", "one", "sub"),
        _steps("low", "lv", "lang", "leaf"),
        _steps("high", "tp", "one", "sub"),
        "w AS (SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, coalesce(changed, leaf.h) AS start, "
        "list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang "
        "LEFT JOIN low ON low.lang IS NOT DISTINCT FROM leaf.lang AND low.idx = leaf.idx LEFT JOIN high ON high.idx = sub.idx)",
        "r AS (SELECT *, (SELECT h FROM tp WHERE m = 1) AS root, array_to_string(list_transform(steps, lambda s: ltrim(s, 'LR-')), '') AS path, "
        "list_reduce(list_concat([start], steps), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM w)\n"
        "SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified FROM r",
    ]
)


@query
def op12_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings by inner product of every twentieth one."""
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
