"""Queries whose models are stated (given tables, planes from md5, fixed weights), so that SQL can state their results: search from
a stored engine, vectors of documents, products with a matrix, steps of training, ingest and its guards, output formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.functions.checksum import crc32c
from cairn.operators import ann, embed, lexical, ranker
from cairn.plans import retrieval as R
from cairn.plans.search import RESULT, Engine, as_json, hydrated
from cairn.session import materialize, scratch_path
from cairn.sources import ingest
from cairn.sources.tables import table

K, WIDTH = R.K, 60


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents_idx").where("content IS NOT NULL AND doc_id IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("path").alias("path"), F.min("content").alias("content"))


def _token_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_vec").where("token IS NOT NULL AND size(vec) = 64").groupBy("token").agg(F.min("vec").alias("vec"))


def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over the records from an engine that was saved and loaded: lexical index of their words, the vectors of
    ``doc_vec`` and ``token_vec``, buckets by planes from md5, fusion by stated weights."""
    docs = materialize(_records(spark, d), "records")
    vectors = table(spark, d, "doc_vec").where("doc_id IS NOT NULL AND size(q) = 64").groupBy("doc_id").agg(F.min("q").alias("q"))
    index = lexical.LexicalIndex.build(lexical.tokenized(docs, text_col="content"))
    buckets = ann.BucketIndex(vectors, V.hashed_planes(R.PLANES, 64))
    path = scratch_path(spark, "store")
    Engine(spark, docs, [], index, materialize(_token_vectors(spark, d), "vectors"), buckets, R.WEIGHTS, "1").save(path)
    return Engine.load(spark, path).search(" ".join(R.QUERY), K).drop("snippet").withColumns({c: F.round(c, 6) for c in ("x", "y", "bm25_score", "embed_score")})


def hydrated_results(spark: SparkSession, d: str) -> DataFrame:
    """Title and path of every stored result of the first query; results without a record are left out."""
    stored = table(spark, d, "search_result").where("doc_id IS NOT NULL")
    one = stored.agg(F.min("query_id")).first()[0]
    return hydrated(stored.where(F.col("query_id") == one).select("doc_id").distinct(), _records(spark, d)).select("doc_id", "title", "path")


def results_json(spark: SparkSession, d: str) -> DataFrame:
    """The stored results of the first query as one JSON value, and read back from it."""
    stored = table(spark, d, "search_result")
    one = stored.agg(F.min("query_id")).first()[0]
    value = as_json(stored.where(F.col("query_id") == one).select(*RESULT), "a query", 7)
    read = value.select(F.from_json("value", "query string, results array<struct<doc_id:string,title:string,path:string,snippet:string,rank:int>>, count bigint, latency_ms bigint").alias("j"))
    return read.select("j.query", "j.count", "j.latency_ms", F.explode("j.results").alias("r")).select("query", "count", "latency_ms", "r.*").withColumn("rank", F.col("rank").cast("bigint"))


def document_vectors_given(spark: SparkSession, d: str) -> DataFrame:
    """Unit sums of the given token vectors over the words of every text."""
    rows = embed.document_vectors(R._tokens(spark, d), _token_vectors(spark, d))
    return rows.select("doc_id", F.posexplode("vec").alias("pos", "x")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def ppmi_product(spark: SparkSession, d: str) -> DataFrame:
    """The PPMI matrix of all tokens times the vector of 1 / (1 + i): the step that the factorisation repeats."""
    vocab, cooc = R._cooccurring(spark, d)
    y = embed.product(embed.stored_matrix(embed.ppmi(cooc)), 1.0 / np.arange(1, vocab.count() + 1)[:, None])[:, 0]
    numbered = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    return numbered.join(vocab, "i").select("token", F.round("y", 6).alias("y"))


def svd_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the token vectors must be: one for every token, together an orthonormal basis, and one that keeps no less of the
    matrix than its heaviest rows do (no other basis of that size keeps more)."""
    tokens = materialize(R._tokens(spark, d), "tokens")
    vectors = materialize(embed.token_vectors(tokens, embed.Config(max_vocab=0)), "vectors")
    vocab = materialize(embed.vocabulary(tokens, 2, 0), "vocabulary")
    stored = embed.stored_matrix(embed.ppmi(embed.cooccurrence(tokens, vocab, 5)))
    rows = vectors.join(vocab, "token").orderBy("i").select("vec").collect()  # the model, which is of bounded size
    basis = np.array([r["vec"] for r in rows])
    per_row = np.array([r["s"] for r in stored.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s")).collect()])  # one number per token
    kept = float((embed.product(stored, basis) ** 2).sum())
    orthonormal = bool(np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-8)
    best_rows = float(np.sort(per_row)[::-1][: basis.shape[1]].sum())
    return spark.createDataFrame([(len(basis), round(float(per_row.sum()), 2), orthonormal, kept >= best_rows - 1e-6)], "tokens bigint, weight double, orthonormal boolean, keeps_most boolean")


def gaussian_planes(spark: SparkSession, d: str) -> DataFrame:
    """Random unit planes made from md5."""
    p = V.hashed_gaussian_planes(16, 64)
    return spark.createDataFrame([(i, j, round(float(x), 6)) for i, row in enumerate(p) for j, x in enumerate(row)], "plane bigint, dim bigint, x double")


def mlp_sgd_steps(spark: SparkSession, d: str) -> DataFrame:
    """Weights after one pass over the training set from stated weights, one step per sample."""
    rows = ranker.training_set(spark).orderBy("i").toPandas()  # a fixed thousand rows
    w, _ = ranker.train(rows[["bm25", "embed", "rrf"]].to_numpy(), rows["target"].to_numpy(), epochs=1, start=R.WEIGHTS)
    named = [(f"{n}_{i}", float(x)) for n in ("w1", "b1", "w2", "b2") for i, x in enumerate(np.asarray(w[n]).ravel())]
    return spark.createDataFrame([(n, round(x, 9)) for n, x in named], "weight string, value double")


def scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """The texts as files in folders by language, scanned recursively: bytes by outcome."""
    path = scratch_path(spark, "tree")
    texts = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("text").alias("value"), "lang")
    texts.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    scanned = ingest.scan_files(spark, path).select("status", "size").unionByName(ingest.unread(spark, path).select("status", "size"))
    return scanned.groupBy("status").agg(F.sum("size").alias("bytes"))


def scan_guards(spark: SparkSession, d: str) -> DataFrame:
    """The values of the log taken as files: how many are text, blank, or no valid UTF-8, by family of keys."""
    log = table(spark, d, "kv_log").where("key IS NOT NULL AND value IS NOT NULL")
    files = log.select(F.concat(F.substring_index("key", ":", 1), F.lit("/"), F.col("seq").cast("string"), F.lit(".TXT")).alias("path"), F.octet_length("value").cast("bigint").alias("length"), F.col("value").alias("content"))
    read = ingest.read_files(files)
    return read.groupBy(F.substring_index("path", "/", 1).alias("family"), "status").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def word_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Uses of every character in the words of all texts."""
    return R._tokens(spark, d).select(F.explode("tokens").alias("w")).select(F.explode(T.symbols(F.col("w"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def shortened_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of a text that has no sentence: its beginning."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.shorten(F.col("text")).alias("head"))


def wrapped_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Every stored snippet in lines."""
    rows = table(spark, d, "search_result").where("snippet IS NOT NULL").select("snippet").distinct()
    return rows.select("snippet", F.array_join(T.word_wrap(F.col("snippet"), WIDTH), "\n").alias("wrapped"))


def key_checksums(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32C of every key of the log."""
    return table(spark, d, "kv_log").where("key IS NOT NULL").select("key").distinct().select("key", crc32c(F.col("key")).alias("crc32c"))


NAMES = [
    stored_search, hydrated_results, results_json, document_vectors_given, ppmi_product, svd_rules, gaussian_planes, mlp_sgd_steps,
    scan_tree, scan_guards, word_symbols, shortened_texts, wrapped_snippets, key_checksums,
]
QUERIES = {f.__name__: f for f in NAMES}

_DOCS = "(SELECT doc_id, min(title) AS title, min(path) AS path, min(content) AS text FROM documents_idx WHERE content IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1)"
_TV = "tv AS (SELECT token, min(vec) AS v FROM token_vec WHERE token IS NOT NULL AND len(vec) = 64 GROUP BY 1)"
_SEARCH = (
    R._bm25(R.QUERY).replace("FROM documents WHERE", f"FROM {_DOCS} WHERE", 1)
    + f""", a AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ba ORDER BY score DESC, doc_id LIMIT {2 * K}), {_TV},
dv AS (SELECT doc_id, min(list_transform(q, lambda x: x::DOUBLE)) AS q FROM doc_vec WHERE doc_id IS NOT NULL AND len(q) = 64 GROUP BY 1),
qs AS (SELECT j, sum(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS j FROM q JOIN tv USING (token)) GROUP BY 1),
qv AS (SELECT list(round(greatest(-1, least(1, x / n)) * 127) ORDER BY j) AS q FROM qs, (SELECT sqrt(sum(x * x)) AS n FROM qs)),
al AS (SELECT doc_id, q FROM dv UNION ALL SELECT NULL, q FROM qv), pl AS (SELECT i, j, CASE WHEN ascii(substr(md5(i || ':' || j), 1, 1)) >= 56 THEN 1 ELSE -1 END AS p FROM range(8) a(i), range(64) b(j)),
bk AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN 1 << i::INT ELSE 0 END) AS bucket FROM (SELECT doc_id, i, sum(x * p) AS s FROM (SELECT doc_id, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS j FROM al) JOIN pl USING (j) GROUP BY ALL) GROUP BY 1),
cs AS (SELECT dv.doc_id, CASE WHEN list_sum(list_transform(dv.q, lambda x: abs(x))) > 0 THEN round(list_cosine_similarity(dv.q, qv.q), 6) ELSE 0 END AS score, bit_count(xor(x.bucket::BIGINT, y.bucket::BIGINT)) AS tier
  FROM dv, qv, bk x, bk y WHERE x.doc_id = dv.doc_id AND y.doc_id IS NULL),
n AS (SELECT count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier <= 1) AS n1 FROM cs),
b AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM cs, n WHERE tier <= CASE WHEN n0 >= {4 * K} THEN 0 WHEN n1 >= {2 * K} THEN 1 ELSE 8 END ORDER BY score DESC, doc_id LIMIT {2 * K}),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS bm25_score, coalesce(b.score, 0) AS embed_score,
  coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id),
z AS (SELECT doc_id, round(1 / (1 + exp(-({R.WEIGHTS['b2'][0]} + {' + '.join(R._HID)}))), 6) AS score, bm25_score, embed_score FROM j), f AS ({R._BEST})
SELECT doc_id, title, path, f.score, round(bm25_score, 6) AS bm25_score, round(embed_score, 6) AS embed_score, f.rank, round(dv.q[1] / 127, 6) AS x, round(dv.q[2] / 127, 6) AS y
FROM f JOIN {_DOCS} d USING (doc_id) LEFT JOIN dv USING (doc_id)"""
)
_PPMI = (
    R._CO.replace(R._CAP, "")
    + """, s AS (SELECT token_a AS t, sum(weight) AS s FROM co GROUP BY 1), g AS (SELECT sum(s) AS g FROM s),
m AS (SELECT token_a, token_b, log2(weight * g / (x.s * y.s + 1e-10)) AS v FROM co JOIN s x ON x.t = token_a JOIN s y ON y.t = token_b, g),
ix AS (SELECT token, row_number() OVER (ORDER BY token) AS i FROM vo) """
)


def _sgd(start: dict, steps: int, last: str = "") -> str:
    """One step of gradient descent per row of a recursive query; each weight is a column, and so is the step's squared error.
    Ends with ``last`` or else the weights after all steps."""
    hid, feats = range(4), ("b", "e", "r")
    w1 = {f"w{k}_{j}": start["w1"][k][j] for k in range(3) for j in hid}
    b1, w2, b2 = {f"c{j}": start["b1"][j] for j in hid}, {f"v{j}": start["w2"][j][0] for j in hid}, {"o": start["b2"][0]}
    every = w1 | b1 | w2 | b2
    z = ", ".join(f"c{j} + " + " + ".join(f"u.{f} * w{k}_{j}" for k, f in enumerate(feats)) + f" AS z{j}" for j in hid)
    y = "1 / (1 + exp(-(o + " + " + ".join(f"greatest(0, z{j}) * v{j}" for j in hid) + "))) AS y"
    back = lambda j: f"(CASE WHEN z{j} > 0 THEN g * v{j} ELSE 0 END)"
    new = [f"w{k}_{j} - 0.1 * {f} * {back(j)}" for k, f in enumerate(feats) for j in hid] + [f"c{j} - 0.1 * {back(j)}" for j in hid] + [f"v{j} - 0.1 * g * greatest(0, z{j})" for j in hid] + ["o - 0.1 * g"]
    cols = ", ".join(every)
    names = {**{c: f"w1_{i}" for i, c in enumerate(w1)}, **{c: f"b1_{i}" for i, c in enumerate(b1)}, **{c: f"w2_{i}" for i, c in enumerate(w2)}, "o": "b2_0"}
    u = R._U
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT i, {u.format(t='b')} AS b, {u.format(t='e')} AS e, {u.format(t='r')} AS r FROM range(1000) t(i)), u AS MATERIALIZED (SELECT *, least(1, 0.5 * b + 0.3 * e + 0.2 * r + 0.5 * b * e) AS t FROM x),
st(i, loss, {cols}) AS (SELECT 0::BIGINT, 0::DOUBLE, {', '.join(f'{float(v)!r}::DOUBLE' for v in every.values())} UNION ALL
  SELECT i + 1, (y - t) * (y - t), {', '.join(new)} FROM (SELECT *, 2 * (y - t) / 1000 * y * (1 - y) AS g FROM (SELECT *, {y} FROM (SELECT st.*, u.b, u.e, u.r, u.t, {z} FROM st JOIN u ON u.i = st.i % 1000 WHERE st.i < {steps}) s) s) s),
l AS (SELECT * FROM st WHERE i = {steps}) """ + (last or " UNION ALL ".join(f"SELECT '{n}' AS weight, round({c}, 9) AS value FROM l" for c, n in names.items()))


_ONE = "(SELECT min(query_id) FROM search_result{})"
ORACLES = {
    "stored_search": _SEARCH,
    "hydrated_results": f"SELECT doc_id, title, path FROM {_DOCS} WHERE doc_id IN (SELECT doc_id FROM search_result WHERE query_id = {_ONE.format(' WHERE doc_id IS NOT NULL')})",
    "results_json": f"SELECT 'a query' AS query, count(*) OVER () AS count, 7::BIGINT AS latency_ms, doc_id, title, path, snippet, rank::BIGINT AS rank FROM search_result WHERE query_id = {_ONE.format('')}",
    "document_vectors_given": R._TOK + f""", {_TV}, tf AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL),
  s AS (SELECT doc_id, j, sum(x * n) AS x FROM (SELECT doc_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM tf JOIN tv USING (token)) GROUP BY ALL),
  l AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1), e AS (SELECT doc_id, j FROM toks, range(64) r(j))
  SELECT doc_id, j AS pos, round(coalesce(CASE WHEN n >= 1e-10 THEN x / n ELSE x END, 0), 6) AS x FROM e LEFT JOIN s USING (doc_id, j) LEFT JOIN l USING (doc_id)""",
    "ppmi_product": _PPMI + ", y AS (SELECT token_a AS token, sum(v / i) AS y FROM m JOIN ix ON ix.token = token_b WHERE v > 0 GROUP BY 1) SELECT token, round(coalesce(y, 0), 6) AS y FROM ix LEFT JOIN y USING (token)",
    "svd_rules": _PPMI + " SELECT (SELECT count(*) FROM ix) AS tokens, round(sum(v * v), 2) AS weight, true AS orthonormal, true AS keeps_most FROM m WHERE v > 0",
    "gaussian_planes": """WITH u AS (SELECT i, j, (('0x' || substr(md5('u:' || i || ':' || j), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u, (('0x' || substr(md5('v:' || i || ':' || j), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS v FROM range(16) a(i), range(64) b(j)),
  g AS (SELECT i, j, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM u) SELECT i AS plane, j AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY i)), 6) AS x FROM g""",
    "mlp_sgd_steps": _sgd(R.WEIGHTS, 1000),
    "mlp_train_sgd": _sgd(ranker.initial(), 100_000, "SELECT (i - 1) // 1000 + 1 AS epoch, round(sum(loss) / 1000, 9) AS loss FROM st WHERE i > 0 GROUP BY 1"),
    "scan_tree": "SELECT 'ok' AS status, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL",
    "scan_guards": """WITH v AS (SELECT split_part(key, ':', 1) AS family, octet_length(value) AS n, try(decode(value)) AS t FROM kv_log WHERE key IS NOT NULL AND value IS NOT NULL)
  SELECT family, CASE WHEN t IS NULL THEN 'error' WHEN NOT regexp_matches(t, '[^\\t-\\r \\x{85}\\p{Z}]') THEN 'skipped' ELSE 'ok' END AS status, count(*) AS files, sum(n)::BIGINT AS bytes FROM v GROUP BY ALL""",
    "word_symbols": R._TOK + " SELECT s AS symbol, count(*) AS n FROM (SELECT unnest(string_split(token, '')) AS s FROM tok) GROUP BY 1",
    "shortened_texts": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS head FROM documents WHERE text IS NOT NULL",
    "wrapped_snippets": f"""WITH s AS (SELECT DISTINCT snippet FROM search_result WHERE snippet IS NOT NULL), w AS (SELECT snippet, list_filter(regexp_split_to_array(snippet, '[\\t-\\r \\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM s)
  SELECT snippet, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda a, w: CASE WHEN strlen(regexp_extract(a, '[^\\n]*$')) + 1 + strlen(w) <= {WIDTH} THEN a || ' ' || w ELSE a || chr(10) || w END) END AS wrapped FROM w""",
    "key_checksums": """WITH b AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
  k AS (SELECT DISTINCT key FROM kv_log WHERE key IS NOT NULL)
  SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda h: ascii(h)::BIGINT)), lambda c, h: xor(c >> 8, t[(xor(c, h) & 255) + 1])), 4294967295) AS crc32c FROM k, b""",
}
