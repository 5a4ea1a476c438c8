"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe_count, chat, decontam, exact_dedup, hard_negatives, html_diff, langid, packing, prefix_trie, secret_scan, simhash, syncmers, warc
from tessella.llm.common import new_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_diff.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "lines_deleted")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = syncmers.with_next(table(spark, sf_dir, "documents"), derived={"anchors": syncmers.anchors(F.col("text"))})
    edited = F.concat(F.expr("left(text, n_chars - n_chars div 3)"), F.col("next_start"))
    docs = docs.withColumns({"edited_sha256": F.sha2(edited, 256), "edited": syncmers.anchors(edited)})
    docs = docs.withColumns({f"{c}_map": syncmers.firsts(F.col(c)) for c in ("anchors", "edited", "next_anchors")})
    return docs.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"), syncmers.fingerprint(F.col("edited")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors_map"), F.col("edited_map")).alias("near_edited"), syncmers.likeness(F.col("anchors_map"), F.col("next_anchors_map")).alias("near_next"),
    )


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), path)
    back = warc.read_archives(spark, path, payload="false").where(F.col("warc_type").isin("response", "revisit"))
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.coalesce("payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("select * from values (-1L, 0L, 'user', :s), (-1L, 1L, 'assistant', :s) as t(conv_id, turn, role, text)", {"s": said})
    made = chat.examples(turns.unionByName(extra))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read = made.select("conv_id", "example", F.length("formatted").alias("size"), "formatted", loss.alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.sum("size").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    back = whole.select("conv_id", "formatted_chars", "loss", chat.read_turns(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", "n_words", decontam.n_hit(F.col("spans")).alias("n_hit"), "items")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("markov"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = e.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole_vectors(e).alias("v"))
    return hard_negatives.mine(items, F.col("id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(written(prefix_trie.sequences(turns), "sequences")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction, op2_simhash_near_dedup, op3_syncmer_fingerprints, op4_warc_archives, op5_chat_formatting,
            op6_benchmark_decontamination, op7_secret_scan, op8_token_counts, op9_language_id, op10_best_fit_packing, op11_exact_dedup,
            op12_hard_negatives, op13_prefix_trie,
        )
    }


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, md5(coalesce(html, '')) AS other FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY n, digest, other) AS largest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM f
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
l AS (
  SELECT *, {len(chat.START) + 1 + len(chat.END)} + length({_escaped("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_escaped("text")}) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR final) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS size, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM items),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, pos.size AS size, item FROM pos JOIN items ON items.size = pos.size AND items.win = array_to_string(pos.w[pos.i : pos.i + pos.size - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP12_SQL = """
WITH u AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT id, label, [floor(256 * x) FOR x IN e] AS e FROM u WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS a, v.id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v a, v WHERE a.id % 100 = 0),
p AS (SELECT a, id, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same AND id <> a) WHERE k <= 5),
n AS (SELECT p.a, p.id AS positive, s.id, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(k AS INT) AS rank, id AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5
"""
OP13_SQL = """
WITH t AS (SELECT coalesce(conv_id, -9223372036854775808) AS c, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations),
o AS (SELECT c, list(d ORDER BY turn NULLS FIRST, d) AS l, list(w ORDER BY turn NULLS FIRST, d) AS ws,
  xor(4294967295, list_reduce(flatten([[ord(ch), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(CAST(c AS VARCHAR), '')]),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384), 4294967295)) % 4 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(b.l[1 : o.h], []), o.l[o.h + 1 :]) AS l, list_concat(coalesce(b.ws[1 : o.h], []), o.ws[o.h + 1 :]) AS ws FROM o LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, l, len(l) AS n, ws, unnest(range(0, len(l) + 1)) AS depth FROM r),
q AS (SELECT *, sha256(array_to_string(l[1 : depth], '')) AS node, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w FROM p),
nodes AS (SELECT node, depth, min(c) AS conv_id, arg_min(l, c) AS l, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY node, depth),
parents AS (SELECT *, CASE WHEN depth > 0 THEN sha256(array_to_string(l[1 : depth - 1], '')) END AS parent FROM nodes),
children AS (SELECT parent AS node, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY parent),
up AS (SELECT x.node, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS saved, sha256(array_to_string(l[1 : k], '')) AS top
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM parents) x LEFT JOIN children USING (node)),
sums AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY top)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM parents x LEFT JOIN parents y ON y.node = x.parent LEFT JOIN children ON children.node = x.node JOIN sums ON sums.node = x.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_archives": OP4_SQL, "op5_chat_formatting": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_exact_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
