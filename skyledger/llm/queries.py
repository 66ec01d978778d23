"""Queries of the document operators over the driver tables; SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import codes, decontaminate, huffman, langid, linededup, media, middle, mixing, packing, secrets, sharding, simhash, toxicity
from skyledger.llm.common import held_out, table

SHARD_BYTES = 1 << 20  # texts of one shard in op4; a store of 100 TB would take 256 MB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}')"


@query(
    "op1_benchmark_decontamination",
    f"""
    WITH doc AS (SELECT doc_id, coalesce({_words_sql("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql('text')} AS w FROM benchmark),
    cut AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0),
    win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t FROM cut),
    place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) x WHERE len(w) >= k),
    spot AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t FROM place),
    hit AS (SELECT doc_id, spot.k AS k, i, item FROM spot JOIN win ON win.k = spot.k AND win.t = spot.t),
    word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) h GROUP BY doc_id),
    held AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) h GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(held.n, 0) AS BIGINT) AS n_items,
           sha256(coalesce(held.items, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
    FROM doc d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id
    """,
)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of ten consecutive words of a benchmark item."""
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(hits)


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the whole table in sequences of at most 2048 tokens, one row per piece."""
    return packing.packing_digest(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, from piece probabilities learned on the other four folds."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest doc_id that links of at most 3 differing bits reach."""
    near = simhash.near_copies(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint(near.fp).alias("fingerprint"), "component_id")


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text and the places of its toxic spans, from a chain fitted on labelled documents of the other four folds."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, table(spark, sf_dir, "labels")), with_spans=True)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


@query("op8_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as they are read back from the Huffman-coded files, in the order of doc_id."""
    return huffman.digest(spark, huffman.write_files(table(spark, sf_dir, "documents")))


@query(
    "op4_extendible_sharding",
    f"""
    WITH RECURSIVE rows AS (
      SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
             CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash
      FROM documents
    ), sums AS (
      SELECT depth, hash >> (60 - depth) AS node, sum(n_bytes) AS bytes FROM rows, range(0, 25) d(depth) GROUP BY 1, 2
    ), leaves AS (
      SELECT r.doc_id, r.n_bytes, r.hash, min(s.depth) AS depth
      FROM rows r JOIN sums s ON s.node = r.hash >> (60 - s.depth) WHERE s.bytes <= {SHARD_BYTES} GROUP BY 1, 2, 3
    )
    SELECT l.doc_id, l.n_bytes, CAST(l.depth AS INTEGER) AS depth, right(lpad(bin(l.hash >> (60 - l.depth)), 64, '0'), CAST(l.depth AS INTEGER)) AS shard, CAST(s.bytes AS BIGINT) AS shard_bytes
    FROM leaves l JOIN sums s ON s.depth = l.depth AND s.node = l.hash >> (60 - l.depth)
    """,
)
def extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document; a shard's texts take at most SHARD_BYTES."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


@query("op9_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: what is left of its text."""
    left = linededup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query("op10_media_columns")
def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an ISO media file, read back, with what its boxes say."""
    return media.digest(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate string of every document with the forest's verdict; trained on findings of the other four folds."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "nth", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


def _pass_sql(number: int) -> str:
    """Documents of a pass over their sources, laid end to end in the order of that pass's hash."""
    key = f"substr(name, {number * mixing.KEY_DIGITS + 1}, {mixing.KEY_DIGITS})"
    return (
        f"SELECT doc_id, size, quota, {number} * source_size + sum(size) OVER (PARTITION BY sid ORDER BY {key}, doc_id) - size AS start "
        f"FROM own WHERE size > 0"
    )


@query(
    "op11_source_mix",
    rf"""
    WITH RECURSIVE doc AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size, sha256('{mixing.SEED}:' || doc_id) AS name FROM documents
    ), src AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM doc GROUP BY source
    ), w AS (
      SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {mixing.MOST_PASSES} * source_size AS cap FROM src
    ), level AS (
      SELECT 0 AS step, CAST(0.0 AS DOUBLE) AS height, -1 AS stopped
      UNION ALL
      SELECT step + 1, CAST((sum(source_size) - coalesce(sum(cap) FILTER (cap < height * weight), 0)) AS DOUBLE) / sum(weight) FILTER (cap >= height * weight), CAST(count(*) FILTER (cap < height * weight) AS INTEGER)
      FROM level, w GROUP BY step, height, stopped HAVING count(*) FILTER (cap < height * weight) > stopped AND sum(source_size) > 0
    ), goal AS (
      SELECT *, least(CAST(cap AS DOUBLE), (SELECT arg_max(height, step) FROM level) * weight) AS target FROM w
    ), own AS (
      SELECT doc.*, sid, source_size, target, CAST(floor(target) AS BIGINT) AS quota FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source
    ), laid AS (
      {' UNION ALL '.join(_pass_sql(k) for k in range(mixing.MOST_PASSES))}
    ), got AS (
      SELECT doc_id, sum(greatest(0, least(start + size, quota) - start)) AS taken FROM laid GROUP BY doc_id
    )
    SELECT own.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM own LEFT JOIN got USING (doc_id)
    """,
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources at their target weights takes of every document."""
    return mixing.digest(table(spark, sf_dir, "documents"))


@query(
    "op12_fill_in_middle",
    r"""
    WITH doc AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS w, sha256('42:' || doc_id) AS h FROM documents
    ), drawn AS (
      SELECT doc_id, t, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM doc
    ), form AS (
      SELECT doc_id, t, n,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
             array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
             array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
      FROM drawn
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM form
    """,
)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into prefix, middle and suffix and laid out anew, and rebuilt from what was laid out."""
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents")))


def _codes_sql() -> str:
    """Codebooks b0 to b4 and assignments a0 to a4, one after the other; products of integers are exact in doubles."""
    dot = "list_inner_product"
    book = f"SELECT part, entry, x, {dot}(x, x) AS xx FROM"
    steps = [f"""
      kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {codes.SCALE})) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      ), part AS MATERIALIZED (
        SELECT vec_id, label, p AS part, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS y FROM kept, range(0, 4) r(p)
      ), b0 AS MATERIALIZED (
        {book} (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS x FROM part) z WHERE entry < {codes.ENTRIES}
      )"""]
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""
      a{k} AS MATERIALIZED (
        SELECT vec_id, label, part, y, min(({dot}(y, y) - 2 * {dot}(x, y) + xx) * 256 + entry) AS best FROM part JOIN b{k} USING (part) GROUP BY ALL
      )""")
        if k < codes.ROUNDS:
            steps.append(f"""
      m{k} AS (
        SELECT part, CAST(best % 256 AS BIGINT) AS entry, d, floor(sum(y[d]) / count(*)) AS mean FROM a{k}, (SELECT unnest(range(1, max(len(y)) + 1)) AS d FROM part) u GROUP BY ALL
      ), b{k + 1} AS MATERIALIZED (
        {book} (SELECT b{k}.part, b{k}.entry, coalesce(n.x, b{k}.x) AS x FROM b{k} LEFT JOIN (SELECT part, entry, list(mean ORDER BY d) AS x FROM m{k} GROUP BY ALL) n USING (part, entry)) z
      )""")
    last = codes.ROUNDS
    return f"""
    WITH {','.join(steps)}, coded AS (
      SELECT vec_id, label, string_agg(lpad(lower(to_hex(CAST(best % 256 AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(floor(best / 256)) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda i: CAST(i AS BIGINT)), 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256
    FROM coded
    """


@query("op13_vector_codes", _codes_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bytes for every vector, from codebooks trained on all of them."""
    return codes.digest(table(spark, sf_dir, "embeddings"))
