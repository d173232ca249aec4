"""Queries over texts, vectors, rankers and the key-value log, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import ann, embed, fusion, kv, lexical, ranker, subwords, summarize
from cairn.plans.search import Engine
from cairn.session import materialize
from cairn.sources import ingest
from cairn.sources.tables import table

QUERY = "the orbit of a comet near the telescope".split()
REPEATED = "glacier glacier drought".split()
VOCAB, K, PLANES = 2000, 10, 64
WEIGHTS = {
    "w1": [[0.5, -0.25, 0.125, 0.75], [0.25, 0.5, -0.5, 0.125], [1.0, -0.75, 0.5, 0.25]],
    "b1": [0.1, 0.2, -0.1, 0.05],
    "w2": [[0.75], [-0.5], [0.25], [0.5]],
    "b2": [-0.25],
}


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexical.tokenized(table(spark, d, "documents"))


def pretokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(_tokens(spark, d))


def doc_frequencies(spark: SparkSession, d: str) -> DataFrame:
    distinct = _tokens(spark, d).select(F.explode(F.array_distinct("tokens")).alias("token"))
    return distinct.groupBy("token").agg(F.count("*").alias("df"))


def doc_lengths_avgdl(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_lengths(_tokens(spark, d)).agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top(lexical.scan_scores(_tokens(spark, d), QUERY), K)


def bm25_duplicate_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top(lexical.scan_scores(_tokens(spark, d), REPEATED), K)


def bm25_index_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = lexical.LexicalIndex.build(_tokens(spark, d)).scores(QUERY)
    return scores.select("doc_id", F.round("score", 6).alias("score"))


def bm25_idf_clamp(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(spark, d)
    n = tokens.count()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.where(lexical.idf(float(n), F.col("df")) <= 0)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").where("fetched_at < TIMESTAMP_NTZ '2024-02-01 00:00:00'").select(F.sha2("text", 256).alias("doc_id"))
    return ingest.against_known(ingest.from_table(table(spark, d, "documents")), known.where("doc_id IS NOT NULL"))


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.report(_scanned(spark, d))


def ingest_antijoin_known(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).where("status = 'ok'").select("doc_id", "path", "title")


def ingest_dedupe_sha256(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_id"))
    return rows.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def ingest_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("path IS NOT NULL")
    ext = T.extension_of(F.col("path"))
    return rows.select("doc_id", T.title_of(F.col("path")).alias("file_title"), ext.alias("extension"), ext.isin(ingest.EXTENSIONS).alias("supported"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.posexplode(V.quantize(F.col("v"))).alias("pos", "q")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("q").cast("bigint").alias("q"))


def dequantize(spark: SparkSession, d: str) -> DataFrame:
    back = V.dequantize(V.quantize(F.col("v")))
    return _vectors(spark, d).select("vec_id", F.posexplode(back).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.posexplode(V.normalize(F.col("v"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 100."""
    return rows.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "q")


def cosine_exact_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("v").alias("q"))
    return ann.exact(rows, _asked(rows), K)


def _quantised(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_vectors(spark, d).select(F.col("vec_id").alias("doc_id"), V.quantize(F.col("v")).alias("q")), "quantised")


def cosine_int8_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = _quantised(spark, d)
    return ann.exact(rows, _asked(rows), K)


def simhash_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = V.with_signatures(_quantised(spark, d), "q", V.hashed_planes(2 * PLANES, 64))
    return rows.select("doc_id", "sig", "sig_high", F.col("bucket").cast("bigint").alias("bucket"))


def simhash_bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ann.BucketIndex(_quantised(spark, d), V.hashed_planes(PLANES, 64)).histogram().select(F.col("bucket").cast("bigint").alias("bucket"), "n")


def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = V.with_signatures(_quantised(spark, d), "q", V.hashed_planes(PLANES, 64)).select("doc_id", F.col("sig").alias("q"))
    nearest = ann.exact(rows, _asked(rows), K, ann.agreements)
    return nearest.select("query_id", "doc_id", (-F.col("score")).cast("bigint").alias("distance"), "rank")


def lsh_topk_tiered(spark: SparkSession, d: str) -> DataFrame:
    rows = _quantised(spark, d)
    return ann.BucketIndex(rows, V.hashed_planes(PLANES, 64)).query(_asked(rows), K)


def lsh_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _quantised(spark, d)
    found = ann.BucketIndex(rows, V.hashed_planes(PLANES, 64)).query(_asked(rows), K)
    return ann.recall(found, ann.exact(rows, _asked(rows), K)).select("query_id", F.round("recall", 6).alias("recall"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of documents: by relevance, and by the share of the query's words a document has."""
    tokens = _tokens(spark, d)
    have = F.size(F.array_intersect("tokens", F.array(*(F.lit(w) for w in QUERY))))
    share = tokens.select("doc_id", (have / (F.lit(float(len(QUERY))) + F.log(F.size("tokens") + 1.0))).alias("score")).where("score > 0")
    return materialize(lexical.top(lexical.scan_scores(tokens, QUERY), 2 * K), "list-a"), materialize(lexical.top(share, 2 * K), "list-b")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*_lists(spark, d), K)


def mlp_fusion_forward(spark: SparkSession, d: str) -> DataFrame:
    return fusion.mlp(*_lists(spark, d), WEIGHTS, K)


def mlp_training_targets(spark: SparkSession, d: str) -> DataFrame:
    return ranker.training_set(spark).select("i", *(F.round(c, 6).alias(c) for c in ("bm25", "embed", "rrf", "target")))


def mlp_train_sgd(spark: SparkSession, d: str) -> DataFrame:
    _, losses = ranker.trained(spark)
    return spark.createDataFrame([(i + 1, round(float(x), 9)) for i, x in enumerate(losses)], "epoch bigint, loss double")


def _cooccurring(spark: SparkSession, d: str, max_vocab: int = 0) -> tuple[DataFrame, DataFrame]:
    tokens = materialize(_tokens(spark, d), "tokens")
    vocab = materialize(embed.vocabulary(tokens, 2, max_vocab), "vocabulary")
    return vocab, materialize(embed.cooccurrence(tokens, vocab, 5), "cooccurrence")


def _named(rows: DataFrame, vocab: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    names = vocab.select("i", "token")
    left, right = names.toDF(a, "token_a"), names.toDF(b, "token_b")
    if embed.bounded(vocab):
        left, right = F.broadcast(left), F.broadcast(right)
    return rows.join(left, a).join(right, b).select("token_a", "token_b", *rest)


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Over the VOCAB most used tokens, as its SQL has it; ``cooccurrence_all`` is over all."""
    vocab, cooc = _cooccurring(spark, d, VOCAB)
    return _named(cooc, vocab, "w1", "w2", F.round("weight", 6).alias("weight"))


def ppmi(spark: SparkSession, d: str) -> DataFrame:
    """Over the VOCAB most used tokens, as its SQL has it; ``ppmi_all`` is over all."""
    vocab, cooc = _cooccurring(spark, d, VOCAB)
    return _named(embed.ppmi(cooc), vocab, "i", "j", F.round("v", 6).alias("v"))


def cooccurrence_all(spark: SparkSession, d: str) -> DataFrame:
    """Over every token used at least twice."""
    vocab, cooc = _cooccurring(spark, d)
    return _named(cooc, vocab, "w1", "w2", F.round("weight", 6).alias("weight"))


def ppmi_all(spark: SparkSession, d: str) -> DataFrame:
    """Over every token used at least twice."""
    vocab, cooc = _cooccurring(spark, d)
    return _named(embed.ppmi(cooc), vocab, "i", "j", F.round("v", 6).alias("v"))


_WHOLE = embed.Config(max_vocab=0)


def svd_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embed.token_vectors(materialize(_tokens(spark, d), "tokens"), _WHOLE)


def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(_tokens(spark, d), "tokens")
    return embed.document_vectors(tokens, embed.token_vectors(tokens, _WHOLE)).select("doc_id", V.quantize(F.col("vec")).alias("q"))


def subword_encode(spark: SparkSession, d: str) -> DataFrame:
    encoded = subwords.encode(_tokens(spark, d), subwords.read_merges())
    return encoded.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _subword_ids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, subwords.Merges, list[str]]:
    """Encoded tokens, their ids, and what the vocabulary is made of."""
    tokens, merges = materialize(_tokens(spark, d), "tokens"), subwords.read_merges()
    encoded, chars = subwords.encode(tokens, merges), subwords.characters(tokens)
    return encoded, subwords.encode_ids(encoded, merges, chars), merges, chars


def subword_ids(spark: SparkSession, d: str) -> DataFrame:
    return _subword_ids(spark, d)[1].select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def subword_decode(spark: SparkSession, d: str) -> DataFrame:
    _, ids, merges, chars = _subword_ids(spark, d)
    return subwords.decode(ids, merges, chars)


def subword_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose encoded tokens do not spell their words, or whose ids do not give back the tokens: none."""
    encoded, ids, merges, chars = _subword_ids(spark, d)
    spelt = encoded.select("doc_id", F.array_join("tokens", "").alias("spelt"), F.array_join("tokens", " ").alias("spaced"))
    rows = _tokens(spark, d).select("doc_id", F.array_join("tokens", "").alias("wanted")).join(spelt, "doc_id").join(subwords.decode(ids, merges, chars), "doc_id")
    return rows.where("spelt <> wanted OR text <> spaced").agg(F.count("*").alias("wrong"))


def subword_lowest_ids(spark: SparkSession, d: str) -> DataFrame:
    """The 100 tokens of lowest id (a listing of the vocabulary, as the feature has it)."""
    return subwords.vocabulary_table(spark, subwords.read_merges(), subwords.characters(_tokens(spark, d))).orderBy("id").limit(100).select("token", F.col("id").cast("bigint").alias("id"))


def pair_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return subwords.pair_frequencies(_tokens(spark, d))


def best_pair(spark: SparkSession, d: str) -> DataFrame:
    return subwords.best_pair(subwords.pair_frequencies(_tokens(spark, d)))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


def sentence_bow(spark: SparkSession, d: str) -> DataFrame:
    words = _sentences(spark, d).select("doc_id", "pos", F.explode(T.bag_words(F.col("sentence"))).alias("word"))
    return words.groupBy("doc_id", "pos", "word").agg(F.count("*").alias("n"))


def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the sentence graphs: pairs of sentences of a document that share a word. The join is on document and word."""
    bow = materialize(sentence_bow(spark, d), "bags")
    norms = bow.groupBy("doc_id", "pos").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a, b = bow.toDF("doc_id", "i", "word", "na"), bow.toDF("doc_id", "j", "word", "nb")
    dots = a.join(b, ["doc_id", "word"]).where("i < j").groupBy("doc_id", "i", "j").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    scored = dots.join(norms.toDF("doc_id", "i", "ni"), ["doc_id", "i"]).join(norms.toDF("doc_id", "j", "nj"), ["doc_id", "j"])
    return scored.select("doc_id", "i", "j", F.round(F.col("dot") / (F.col("ni") * F.col("nj")), 6).alias("similarity"))


def textrank_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = summarize.snippets(table(spark, d, "documents"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence", F.round("score", 6).alias("score"))


def kv_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return kv.live(table(spark, d, "kv_log")).select("key", "seq", "ts")


def kv_compaction(spark: SparkSession, d: str) -> DataFrame:
    return kv.compact(table(spark, d, "kv_log")).select("key", F.sha2("value", 256).alias("value_sha256"))


def kv_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(table(spark, d, "kv_log"), "embed:").select("key", "seq")


def kv_point_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(table(spark, d, "kv_log"), "meta:doc_count").select("key", "seq", F.col("value").cast("string").alias("value"))


def kv_replay(spark: SparkSession, d: str) -> DataFrame:
    return kv.replay(table(spark, d, "kv_log")).groupBy(F.col("op").cast("bigint").alias("op")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def kv_stats(spark: SparkSession, d: str) -> DataFrame:
    return kv.stats(table(spark, d, "kv_log"))


SEARCH = "the orbit of a comet near the telescope"


def built_engine(spark: SparkSession, d: str) -> Engine:
    """All models over the whole collection of records."""
    docs = table(spark, d, "documents_idx").where("content IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("path", "title", "content")).alias("m"))
    return Engine.build(docs.select("doc_id", "m.title", "m.path", "m.content"), _WHOLE)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Build and one query over the whole collection of records."""
    return built_engine(spark, d).search(SEARCH, K)


def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes")).first()
    log = kv.stats(table(spark, d, "kv_log")).first()
    row = (docs["documents"], docs["bytes"], log["puts"], log["deletes"], kv.live(table(spark, d, "kv_log")).count())
    return spark.createDataFrame([row], "documents bigint, bytes bigint, puts bigint, deletes bigint, live_keys bigint")


NAMES = [
    pretokenize_counts, term_frequencies, doc_frequencies, doc_lengths_avgdl, bm25_topk, bm25_duplicate_query_terms, bm25_index_scores, bm25_idf_clamp,
    ingest_report, ingest_antijoin_known, ingest_dedupe_sha256, ingest_titles, quantize_int8, dequantize, l2_normalize, cosine_exact_knn, cosine_int8_knn,
    simhash_signature, simhash_bucket_histogram, hamming_topk, lsh_topk_tiered, lsh_recall_at_k, rrf_fusion, mlp_fusion_forward, mlp_training_targets, mlp_train_sgd,
    cooccurrence, ppmi, cooccurrence_all, ppmi_all, svd_embeddings, document_embeddings, subword_encode, subword_ids, subword_decode, subword_roundtrip, subword_lowest_ids, pair_frequencies, best_pair,
    sentence_split, sentence_bow, sentence_similarity, textrank_snippets, kv_latest_wins, kv_compaction, kv_prefix_scan, kv_point_get, kv_replay, kv_stats, hybrid_search, engine_stats,
]
QUERIES = {f.__name__: f for f in NAMES}

_TOK = rf"""WITH toks AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{T.PRE}'), lambda t: CASE WHEN regexp_matches(t, '^[\p{{P}}\p{{S}}]') THEN t ELSE lower(t) END) AS ts
  FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM toks)"""


def _bm25(query: list[str]) -> str:
    terms = ", ".join(f"('{w}')" for w in query)
    return (
        _TOK
        + f""", q(token) AS (VALUES {terms}), l AS (SELECT doc_id, len(ts) AS dl FROM toks), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l),
tf AS (SELECT token, doc_id, count(*) AS tf FROM tok WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT doc_id, sum(greatest(0, ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN l USING (doc_id), s GROUP BY 1),
ba AS (SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0)"""
    )


_TOP = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ba ORDER BY score DESC, doc_id LIMIT {K}"
_SCAN = """WITH k AS (SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL AND fetched_at < TIMESTAMP '2024-02-01'),
s AS (SELECT sha256(text) AS id, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS title, strlen(text) AS size,
  CASE WHEN text IS NULL THEN 'error' WHEN NOT regexp_matches(text, '[^\\t-\\r \\x{85}\\p{Z}]') THEN 'skipped' ELSE 'ok' END AS st FROM documents),
f AS (SELECT id, min(path) AS p FROM s WHERE st = 'ok' GROUP BY 1),
t AS (SELECT s.id, path, title, size, CASE WHEN st = 'ok' AND (s.id IN (SELECT id FROM k) OR path <> f.p) THEN 'duplicate' ELSE st END AS st FROM s LEFT JOIN f USING (id))
"""
_VEC = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id AS doc_id, list_transform(v, lambda x: round(greatest(-1, least(1, x)) * 127)) AS q FROM v)"""
_KNN = """, p AS (SELECT a.doc_id AS query_id, b.doc_id, round(list_cosine_similarity(a.{c}, b.{c}), 6) AS score FROM {t} a, {t} b WHERE a.doc_id % 100 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)"""
_SIG = (
    _VEC
    + """, pl AS (SELECT i, j, CASE WHEN ascii(substr(md5(i || ':' || j), 1, 1)) >= 56 THEN 1 ELSE -1 END AS p FROM range(128) a(i), range(64) b(j)),
x AS (SELECT doc_id, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS j FROM q),
bits AS (SELECT doc_id, i, (sum(x * p) >= 0)::INT AS bit FROM x JOIN pl USING (j) GROUP BY ALL),
raw AS (SELECT doc_id, sum(CASE WHEN i < 64 AND bit = 1 THEN 1::HUGEINT << i::INT ELSE 0 END) AS lo, sum(CASE WHEN i >= 64 AND bit = 1 THEN 1::HUGEINT << (i - 64)::INT ELSE 0 END) AS hi FROM bits GROUP BY 1),
sg AS (SELECT doc_id, (CASE WHEN lo > 9223372036854775807 THEN lo - 18446744073709551616 ELSE lo END)::BIGINT AS sig,
  (CASE WHEN hi > 9223372036854775807 THEN hi - 18446744073709551616 ELSE hi END)::BIGINT AS sig_high, (lo % 256)::BIGINT AS bucket FROM raw)"""
)
_LSH = (
    _SIG
    + _KNN.format(c="q", t="q")
    + f""", c AS (SELECT p.query_id, p.doc_id, score, bit_count(xor(x.bucket, y.bucket)) AS tier FROM p JOIN sg x ON x.doc_id = p.query_id JOIN sg y ON y.doc_id = p.doc_id),
n AS (SELECT query_id, count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier <= 1) AS n1 FROM c GROUP BY 1),
w AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c JOIN n USING (query_id)
  WHERE tier <= CASE WHEN n0 >= {2 * K} THEN 0 WHEN n1 >= {K} THEN 1 ELSE 8 END)"""
)
_FUSE = (
    _bm25(QUERY)
    + f""", a AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ba ORDER BY score DESC, doc_id LIMIT {2 * K}),
sh AS (SELECT doc_id, round(len(list_intersect(ts, [{', '.join(f"'{w}'" for w in QUERY)}])) / ({float(len(QUERY))} + ln(len(ts) + 1)), 6) AS score FROM toks),
b AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sh WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {2 * K}),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS bm25_score, coalesce(b.score, 0) AS embed_score,
  coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)"""
)
_BEST = f"SELECT doc_id, score, bm25_score, embed_score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z ORDER BY score DESC, doc_id LIMIT {K}"
_HID = [f"greatest(0, {WEIGHTS['b1'][j]} + bm25_score * {WEIGHTS['w1'][0][j]} + embed_score * {WEIGHTS['w1'][1][j]} + rrf * {WEIGHTS['w1'][2][j]}) * {WEIGHTS['w2'][j][0]}" for j in range(4)]
_CO = (
    _TOK
    + f""", vo AS (SELECT token, count(*) AS f FROM tok GROUP BY 1 HAVING count(*) >= 2 ORDER BY f DESC, token LIMIT {VOCAB}), kt AS (SELECT * FROM tok WHERE token IN (SELECT token FROM vo)),
co AS (SELECT a.token AS token_a, b.token AS token_b, sum(60 // abs(a.pos - b.pos)) / 60.0 AS weight FROM kt a JOIN kt b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 GROUP BY ALL)"""
)
_SENT = rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])([\t-\r \x{{85}}\p{{Z}}]|\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), '\n(\n+)', chr(10) || chr(1) || '\1', 'g'), chr(1)) AS p
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_filter(list_transform(p, lambda s: regexp_replace(regexp_replace(s, '^[\t-\r \x{{85}}\p{{Z}}]+', ''), '[\t-\r \x{{85}}\p{{Z}}]+$', '')), lambda s: strlen(s) > 15) AS p FROM c),
se AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS pos FROM t)"""
_BOW = _SENT + r""", bw AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '[\p{L}\p{Nd}]+'), lambda w: strlen(w) > 2)) AS word FROM se),
bo AS (SELECT doc_id, pos, word, count(*) AS n FROM bw GROUP BY ALL)"""
_KV = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kv_log WHERE op IN (1, 2) AND key IS NOT NULL),
lv AS (SELECT * FROM w WHERE rn = 1 AND op = 1)"""
_EXT = ", ".join(f"'{e}'" for e in ingest.EXTENSIONS)
_U = "('0x' || substr(md5('{t}:' || i), 1, 8))::BIGINT / 4294967296.0"

ORACLES = {
    "pretokenize_counts": _TOK + " SELECT token, count(*) AS n FROM tok GROUP BY 1",
    "term_frequencies": _TOK + " SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL",
    "doc_frequencies": _TOK + " SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1",
    "doc_lengths_avgdl": _TOK + " SELECT count(*) AS docs, sum(len(ts))::BIGINT AS tokens, round(avg(len(ts)), 6) AS avgdl FROM toks",
    "bm25_topk": _bm25(QUERY) + _TOP,
    "bm25_duplicate_query_terms": _bm25(REPEATED) + _TOP,
    "bm25_index_scores": _bm25(QUERY) + " SELECT doc_id, score FROM ba",
    "bm25_idf_clamp": _TOK + ", f AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1) SELECT token, df FROM f WHERE ln((SELECT count(*) FROM toks) - df + 0.5) - ln(df + 0.5) <= 0",
    "ingest_report": _SCAN + """SELECT count(*) AS total, count(*) FILTER (st = 'ok') AS ingested, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'duplicate') AS duplicates,
  count(*) FILTER (st = 'error') AS errors, coalesce(sum(size) FILTER (st = 'ok'), 0)::BIGINT AS bytes FROM t""",
    "ingest_antijoin_known": _SCAN + "SELECT id AS doc_id, path, title FROM t WHERE st = 'ok'",
    "ingest_dedupe_sha256": "SELECT sha256(text) AS content_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "ingest_titles": f"""WITH e AS (SELECT doc_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS file_title, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS extension FROM documents WHERE path IS NOT NULL)
  SELECT *, extension IN ({_EXT}) AS supported FROM e""",
    "quantize_int8": _VEC + " SELECT doc_id AS vec_id, unnest(q)::BIGINT AS q, (generate_subscripts(q, 1) - 1)::BIGINT AS pos FROM q",
    "dequantize": _VEC + " SELECT doc_id AS vec_id, round(unnest(q) / 127, 6) AS x, (generate_subscripts(q, 1) - 1)::BIGINT AS pos FROM q",
    "l2_normalize": _VEC + " SELECT vec_id, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x, (generate_subscripts(v, 1) - 1)::BIGINT AS pos FROM v",
    "cosine_exact_knn": _VEC + ", d AS (SELECT vec_id AS doc_id, v FROM v)" + _KNN.format(c="v", t="d") + f" SELECT * FROM e WHERE rank <= {K}",
    "cosine_int8_knn": _VEC + _KNN.format(c="q", t="q") + f" SELECT * FROM e WHERE rank <= {K}",
    "simhash_signature": _SIG + " SELECT doc_id, sig, sig_high, bucket FROM sg",
    "simhash_bucket_histogram": _SIG + " SELECT bucket, count(*) AS n FROM sg GROUP BY 1",
    "hamming_topk": _SIG + f""", p AS (SELECT a.doc_id AS query_id, b.doc_id, bit_count(xor(a.sig, b.sig))::BIGINT AS distance FROM sg a, sg b WHERE a.doc_id % 100 = 0),
  e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p) SELECT * FROM e WHERE rank <= {K}""",
    "lsh_topk_tiered": _LSH + f" SELECT query_id, doc_id, score, rank FROM w WHERE rank <= {K}",
    "lsh_recall_at_k": _LSH + f""" SELECT e.query_id, round(count(w.doc_id) / count(*), 6) AS recall FROM e LEFT JOIN (SELECT * FROM w WHERE rank <= {K}) w ON w.query_id = e.query_id AND w.doc_id = e.doc_id
  WHERE e.rank <= {K} GROUP BY 1""",
    "rrf_fusion": _FUSE + ", z AS (SELECT doc_id, round(rrf, 6) AS score, bm25_score, embed_score FROM j) " + _BEST,
    "mlp_fusion_forward": _FUSE + f", z AS (SELECT doc_id, round(1 / (1 + exp(-({WEIGHTS['b2'][0]} + {' + '.join(_HID)}))), 6) AS score, bm25_score, embed_score FROM j) " + _BEST,
    "mlp_training_targets": f"""WITH u AS (SELECT i, {_U.format(t='b')} AS b, {_U.format(t='e')} AS e, {_U.format(t='r')} AS r FROM range(1000) t(i))
  SELECT i, round(b, 6) AS bm25, round(e, 6) AS embed, round(r, 6) AS rrf, round(least(1, 0.5 * b + 0.3 * e + 0.2 * r + 0.5 * b * e), 6) AS target FROM u""",
    "cooccurrence": _CO + " SELECT token_a, token_b, round(weight, 6) AS weight FROM co",
    "ppmi": _CO + """, s AS (SELECT token_a AS t, sum(weight) AS s FROM co GROUP BY 1), g AS (SELECT sum(s) AS g FROM s),
  m AS (SELECT token_a, token_b, log2(weight * g / (x.s * y.s + 1e-10)) AS v FROM co JOIN s x ON x.t = token_a JOIN s y ON y.t = token_b, g) SELECT token_a, token_b, round(v, 6) AS v FROM m WHERE v > 0""",
    "subword_roundtrip": "SELECT 0::BIGINT AS wrong",
    "pair_frequencies": _TOK + """, w AS (SELECT token AS w, count(*) AS f FROM tok WHERE length(token) > 1 GROUP BY 1), p AS (SELECT w, f, unnest(range(1, length(w))) AS i FROM w)
  SELECT substr(w, i, 1) AS "left", substr(w, i + 1, 1) AS "right", sum(f)::BIGINT AS freq FROM p GROUP BY ALL""",
    "best_pair": _TOK + """, w AS (SELECT token AS w, count(*) AS f FROM tok WHERE length(token) > 1 GROUP BY 1), p AS (SELECT w, f, unnest(range(1, length(w))) AS i FROM w),
  g AS (SELECT substr(w, i, 1) AS "left", substr(w, i + 1, 1) AS "right", sum(f)::BIGINT AS freq FROM p GROUP BY ALL) SELECT * FROM g WHERE freq >= 2 ORDER BY freq DESC, "left" || "right", "left" LIMIT 1""",
    "sentence_split": _SENT + " SELECT doc_id, pos, sentence FROM se",
    "sentence_bow": _BOW + " SELECT * FROM bo",
    "sentence_similarity": _BOW + """, nn AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS norm FROM bo GROUP BY ALL), dd AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.n * b.n) AS dot FROM bo a
  JOIN bo b ON a.doc_id = b.doc_id AND a.word = b.word AND a.pos < b.pos GROUP BY ALL) SELECT dd.doc_id, i, j, round(dot / (x.norm * y.norm), 6) AS similarity FROM dd
  JOIN nn x ON x.doc_id = dd.doc_id AND x.pos = i JOIN nn y ON y.doc_id = dd.doc_id AND y.pos = j""",
    "kv_latest_wins": _KV + " SELECT key, seq, ts FROM lv",
    "kv_compaction": _KV + " SELECT key, sha256(value) AS value_sha256 FROM lv",
    "kv_prefix_scan": _KV + " SELECT key, seq FROM lv WHERE starts_with(key, 'embed:') ORDER BY key",
    "kv_point_get": _KV + " SELECT key, seq, decode(value) AS value FROM lv WHERE key = 'meta:doc_count'",
    "kv_replay": "SELECT op::BIGINT AS op, count(*) AS n, max(seq) AS last FROM kv_log WHERE seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM kv_log WHERE op IS NULL OR op NOT IN (1, 2, 3)) GROUP BY 1",
    "kv_stats": """SELECT count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes, count(*) FILTER (op = 3) AS commits, count(*) FILTER (op IS NULL OR op NOT IN (1, 2, 3)) AS torn,
  coalesce(sum(strlen(key) + coalesce(octet_length(value), 0)) FILTER (op = 1), 0)::BIGINT AS bytes_put FROM kv_log""",
    "engine_stats": _KV + """ SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes,
  (SELECT count(*) FROM kv_log WHERE op = 1) AS puts, (SELECT count(*) FROM kv_log WHERE op = 2) AS deletes, (SELECT count(*) FROM lv) AS live_keys""",
}
_CAP = f" ORDER BY f DESC, token LIMIT {VOCAB}"
ORACLES |= {f"{name}_all": ORACLES[name].replace(_CAP, "") for name in ("cooccurrence", "ppmi")}

# Rank of sentences: each has the edges to the sentences that share words, and one without weight to itself.
_RANK = (
    _BOW.replace("WITH c AS", "WITH RECURSIVE c AS", 1)
    + """, nn AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS norm FROM bo GROUP BY ALL), dd AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.n * b.n) AS dot FROM bo a
  JOIN bo b ON a.doc_id = b.doc_id AND a.word = b.word AND a.pos <> b.pos GROUP BY ALL),
sm AS (SELECT dd.doc_id, i, j, dot / (x.norm * y.norm) AS s FROM dd JOIN nn x ON x.doc_id = dd.doc_id AND x.pos = i JOIN nn y ON y.doc_id = dd.doc_id AND y.pos = j),
od AS (SELECT doc_id, i, sum(s) AS o FROM sm GROUP BY ALL), ct AS (SELECT doc_id, count(*) AS n FROM se GROUP BY 1),
eg AS MATERIALIZED (SELECT sm.doc_id, sm.i, j, s / o AS w, n FROM sm JOIN od ON od.doc_id = sm.doc_id AND od.i = sm.i JOIN ct ON ct.doc_id = sm.doc_id WHERE o >= 1e-10 AND n > 3
  UNION ALL SELECT doc_id, pos, pos, 0, n FROM se JOIN ct USING (doc_id) WHERE n > 3),
rk(doc_id, i, step, r, done) AS (SELECT doc_id, pos, 0, 1.0::DOUBLE / n, false FROM se JOIN ct USING (doc_id) WHERE n > 3
  UNION ALL SELECT doc_id, j, step, y, sqrt(sum((y - old) * (y - old)) OVER (PARTITION BY doc_id)) < 1e-6 FROM (SELECT rk.doc_id, eg.j, rk.step + 1 AS step,
    0.15 / any_value(n) + 0.85 * sum(r * w) AS y, sum(CASE WHEN eg.i = eg.j THEN r END) AS old FROM rk JOIN eg ON eg.doc_id = rk.doc_id AND eg.i = rk.i WHERE NOT done AND rk.step < 50 GROUP BY ALL)),
fr AS (SELECT doc_id, i AS pos, round(arg_max(r, step), 12) AS score FROM rk GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM fr),
ch AS (SELECT doc_id, pos, sentence, score, row_number() OVER w AS rn, sum(strlen(sentence)) OVER w AS size FROM tp JOIN se USING (doc_id, pos) WHERE rn <= 3 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, sentence, round(score, 6) AS score FROM ch WHERE rn = 1 OR size <= 500
UNION ALL SELECT doc_id, pos, sentence, 1.0 FROM se JOIN ct USING (doc_id) WHERE n <= 3"""
)
ORACLES["textrank_snippets"] = _RANK


def subword_oracles() -> dict[str, str]:
    """SQL that has the merge rules in it; none where the file of the tokenizer is missing.

    A word is written as its symbols, each between chr(1) and chr(2), so joining a pair everywhere is one replacement. Each
    step takes the rule of least rank above the last one among the pairs that stand there.
    """
    try:
        merges = subwords.read_merges()
    except OSError:
        return {}
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i},{q(a)},{q(b)})" for i, (a, b) in enumerate(merges))
    base = (
        _TOK.replace("WITH toks", "WITH RECURSIVE toks", 1)
        + f""", ru(rank, l, r) AS (VALUES {rules}), wd AS (SELECT DISTINCT token AS w FROM tok),
st(w, s, last) AS (SELECT w, regexp_replace(w, '(.)', chr(1) || '\\1' || chr(2), 'g'), -1 FROM wd
  UNION ALL SELECT w, replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)), rank FROM (
    SELECT w, any_value(s) AS s, min(rank) AS rank, arg_min(ru.l, rank) AS l, arg_min(ru.r, rank) AS r FROM (
      SELECT w, s, last, unnest(y[:-2]) AS a, unnest(y[2:]) AS b FROM (SELECT w, s, last, string_split(replace(substr(s, 2), chr(2), ''), chr(1)) AS y FROM st) WHERE len(y) > 1) p
      JOIN ru ON ru.l = p.a AND ru.r = p.b WHERE rank > last GROUP BY w)),
en AS (SELECT w, string_split(replace(substr(arg_max(s, last), 2), chr(2), ''), chr(1)) AS y FROM st GROUP BY w),
ts AS (SELECT doc_id, list(y ORDER BY pos) AS y FROM tok JOIN en ON en.w = tok.token GROUP BY 1),
td AS (SELECT toks.doc_id, coalesce(flatten(y), []) AS y FROM toks LEFT JOIN ts USING (doc_id)),
ch AS (SELECT DISTINCT unnest(string_split(l || r, '')) AS t FROM ru UNION SELECT DISTINCT unnest(string_split(w, '')) FROM wd),
vo AS (SELECT t, row_number() OVER (ORDER BY kind, k, t) - 1 AS id FROM (SELECT t, min(kind) AS kind, arg_min(k, kind) AS k FROM (
    SELECT t, 0 AS kind, 0 AS k FROM ch UNION ALL SELECT l || r, 1, min(rank) FROM ru GROUP BY 1) GROUP BY t)),
ids AS (SELECT doc_id, list(coalesce(id, -1) ORDER BY nr) AS ids FROM (SELECT doc_id, unnest(y) AS t, generate_subscripts(y, 1) AS nr FROM td) JOIN vo USING (t) GROUP BY 1)"""
    )
    return {
        "subword_encode": base + " SELECT doc_id, array_to_string(y, ' ') AS tokens FROM td",
        "subword_ids": base + " SELECT td.doc_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM td LEFT JOIN ids USING (doc_id)",
        "subword_decode": base + " SELECT doc_id, array_to_string(y, ' ') AS text FROM td",
        "subword_roundtrip": base + " SELECT count(*) AS wrong FROM td JOIN toks USING (doc_id) WHERE array_to_string(y, '') <> array_to_string(ts, '')",
        "subword_lowest_ids": base + " SELECT t AS token, id FROM vo WHERE id < 100",
    }


ORACLES |= subword_oracles()
