"""The registered queries of this subpackage, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import bpe, chat, exact, fingerprint, html_labels, htmlmain, langid, lm, minhash, mixing, periodic, secretscan, whiten, winnow
from rankframe.llm.common import crc_bucket, table

WORD_BPE = "word_bpe_49k.json"


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(WORD_BPE)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def held_out(mod: int):
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(crc_bucket("doc_id", mod) == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc_bucket("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = F.coalesce(crc_bucket("doc_id", 7) != 2, F.lit(True))
    found = lm.score(docs, lm.train(docs, word_bpe_path(), training), training)
    held = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, word_bpe_path(), keep_text=False)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chat(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "kind", "call_id", "status", "level", "step", F.array_join("errors", "; ").alias("errors"), "json")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fingerprint.with_next(table(spark, sf_dir, "documents"))
    n, put = F.char_length("text"), F.floor(F.char_length("text") / 4)
    edited = F.concat(F.substring("text", F.lit(1), (n - put).cast("int")), F.substring("next_text", F.lit(1), put.cast("int")))
    near = near.withColumn("edited", edited).withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    mine, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return near.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint.as_text(mine).alias("fingerprint"), fingerprint.as_text(other).alias("edited_fingerprint"),
                       fingerprint.resemblance(mine, other).alias("near_edited"), fingerprint.resemblance(mine, after).alias("near_next"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.train(spark))
    return found.select("doc_id", "nth", F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("masked"), F.length("candidate").alias("n_chars"),
                        F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = htmlmain.extract(pages, html_labels.trained(), keep_html=False)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sets = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    told = sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = winnow.join_spread(found.filter("item_set IS NOT NULL").drop("places"), told, ["item_set"])
    clean = found.filter("item_set IS NULL").withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit("").cast("binary"), 256))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")]
    return hit.select(*names).union(clean.select(*names))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whiten.fixed_point(F.col("embedding")).alias("vector"))
    return whiten.whiten(rows)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    edited = periodic.repeated_from(F.col("text"), lambda n: g % n, lambda n: 1 + F.floor((n - g % n) / (3 + g % 8)))
    docs = docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs, keep_text=False).withColumn("best", periodic.strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_exact_dedup, op3_language_id, op4_lm_score, op5_bpe, op6_chat, op7_fingerprint, op8_secrets, op9_mixing, op10_html, op11_winnow, op12_whiten, op13_periodic)}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_chat": """
        WITH e AS (
            SELECT conv_id, turn, coalesce(text, '') AS text,
                   CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, role,
                   CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
            FROM conversations),
        met AS (SELECT call_id AS m_id, bool_or(kind = 'call') AS called, bool_or(kind = 'result') AS answered
                FROM e WHERE call_id IS NOT NULL GROUP BY 1)
        SELECT conv_id, turn, kind, call_id,
               CASE WHEN kind = 'message' THEN 'message' WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'open' ELSE 'linked' END AS status,
               CAST(CASE WHEN called THEN 0 END AS BIGINT) AS level, CAST(CASE WHEN called AND kind = 'call' THEN 0 WHEN called THEN 1 END AS BIGINT) AS step,
               CASE WHEN kind = 'call' AND text = '' THEN '$.prompt: length out of bounds' ELSE '' END AS errors,
               CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text) || '},"id":' || to_json(call_id) || ',"name":"reply"}'
                    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":' || to_json(call_id) || '}'
                    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
        FROM e LEFT JOIN met ON call_id = m_id
    """,
    "op11_winnow": r"""
        WITH read AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        split AS (SELECT kind, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM read),
        items AS (SELECT id, w, least(len(w), 10) AS m FROM split WHERE kind = 'i' AND len(w) > 0),
        windows AS (SELECT DISTINCT id, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM items)),
        docs AS (SELECT r, id, w FROM split WHERE kind = 'd'),
        places AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, (SELECT DISTINCT m FROM windows)),
        texts AS (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM places),
        hits AS (SELECT r, p, m, id FROM texts JOIN windows USING (m, s)),
        words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS i FROM (SELECT DISTINCT r, p, m FROM hits)) GROUP BY r),
        found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT r, id::VARCHAR AS item FROM hits WHERE id IS NOT NULL) GROUP BY r)
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
    """,
    # crc32 bit by bit; equal words of a document at one distance, islands of them are stretches
    "op13_periodic": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                       lambda c: list_transform(range(8), lambda b: ((ascii(c)::BIGINT >> b) & 1))))),
                       lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) AS h
            FROM documents),
        g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
        a AS (SELECT *, g % greatest(n, 1) AS a FROM g),
        e AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                  THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
                  ELSE w END AS w FROM a),
        words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM e),
        same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
        stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island),
        runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
        told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM e LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
    """,
}
